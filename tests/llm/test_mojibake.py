import pytest

from loomgraph.llm.mojibake import examine, repair

TEXTS = {
    "fr": "La société près du vieux marché reçoit l'héritier à la fin du récit – « la clé » déjà usée.",
    "de": "Der Fährmann im kühlen Frühjahr überrascht die Übersetzerin für ein größeres Publikum.",
    "es": "El público de la última función siguió el sueño con ánimo distinto según la crónica.",
    "pl": "Książka według dawnej kroniki, żołnierz spośród wielu, ścieżka i źródło w mgle.",
}
CLEAN = [
    "The printer set “Ã” and “Â” as ornaments on every page.", "A sign read SÃO JOÃO – ÂNGELO E FILHOS.", "One poster says «КИНО», another «ΣΙΝΕΜΑ», a third 映画.", "В конце зала сидит старый механик.",
    "The reel ran at −4 °C, ½ the usual speed, for £3 a seat. ±2 %; © by the estate, 12 €, 15 ¥.", "Þórunn Ðagsdal reads the ÂGE D'OR notices.", "a rival gar\xadrison", "¿Qué año? «Señor»", "The ledger lists MAÇÃ, PÃO and CHÁ.", "naïve café – Ærø",
]


@pytest.mark.parametrize("text", [*CLEAN, *TEXTS.values()])
def test_correct_text_is_left_alone(text):
    assert examine(text) == (0, 0, text)


@pytest.mark.parametrize("wrong", ["cp1252", "latin-1", "mac_roman", "cp437", "cp850", "cp1251", "koi8_r"])
@pytest.mark.parametrize("lang", ["fr", "de", "es"])
def test_multi_byte_round_trip(wrong, lang):
    t = TEXTS[lang]
    n, lost, back = examine(t.encode().decode(wrong))
    assert n > 0 and back == t


def test_double_and_partial():
    t = TEXTS["fr"]
    twice = t.encode().decode("latin-1").encode().decode("latin-1")
    assert examine(twice)[2] == t
    part = "Déjà vu, " + "près du marché".encode().decode("cp1252") + ", et déjà lu “Ã”."
    assert examine(part)[2] == "Déjà vu, près du marché, et déjà lu “Ã”."


@pytest.mark.parametrize("true,wrong,lang", [("cp1252", "mac_roman", "fr"), ("cp1252", "cp850", "es"), ("cp1252", "cp1251", "de"), ("cp1250", "cp1252", "pl")])
def test_single_byte_is_found(true, wrong, lang):
    words = TEXTS[lang].replace("–", "-").replace("«", "").replace("»", "")
    assert examine(words.encode(true).decode(wrong))[0] > 0


def test_lost_and_wide():
    n, lost, _ = examine("Le ch�teau")
    assert n == lost == 1
    assert examine("see " + b"the quiet harbour at dawn.".decode("utf-16-le") + " end")[2] == "see the quiet harbour at dawn. end"
    assert examine("贸藕n膮 jesieni膮")[0] > 0


def test_frames_with_dirt(spark):
    bad = TEXTS["fr"].encode().decode("cp1252")
    rows = [(1, bad, 1), (1, bad, 1), (2, None, 1), (3, "", 1), (4, "plain", 1), (5, "x" * 300_000 + " " + bad, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_spans int")
    got = repair(df).collect()
    assert sorted(r.doc_id for r in got) == [1, 1, 5]
    assert all(r.restored.endswith(TEXTS["fr"]) for r in got)
    assert repair(df.limit(0)).collect() == []


RUSSIAN = "Война и мир. Старый капитан медленно открыл тяжелую дверь"


@pytest.mark.parametrize(
    "text, true, wrong",
    [
        (RUSSIAN, "cp1251", "cp1252"),
        (RUSSIAN, "koi8_r", "cp1251"),
        (RUSSIAN, "utf-8", "koi8_r"),
        ("café à la crème, déjà", "utf-8", "cp932"),
        ("schöne Höhe über", "utf-8", "cp1253"),
        ("już świat miał wiosną", "utf-8", "cp1250"),
    ],
)
def test_other_encodings_are_restored(text, true, wrong):
    garbled = text.encode(true).decode(wrong)
    found, lost, restored = examine(garbled)
    assert found and restored == text


def test_rows_of_letters_and_other_scripts_are_left_alone():
    for text in (RUSSIAN, "Ελληνικά και άλλα γράμματα", "äöüß und áéíóú sind Buchstaben", "żółć gęślą jaźń", "Привет, ЭТО правда МГУ", "老船长慢慢推开灯塔", "コーヒーとﾊﾝｶｸ文字", "Łódź, Ángel, Œuvre, Ærø"):
        assert examine(text) == (0, 0, text)
