"""Garbled text from a wrong character encoding: found by a multi-pattern automaton, restored span by span.

For every pair (true encoding, wrong encoding) the sequences that a wrong decoding makes of the letters and signs of
European text are computed beforehand, from the encodings themselves:

* multi-byte: UTF-8 read as a single-byte encoding or as GBK, once or twice ("Ã©", "â€“", "√©", "ÃƒÂ©", "茅");
* single-byte: one single-byte encoding read as another ("clÈ", "g¹sior", "Tьren"). What comes out is one ordinary
  character, so it counts only where no writing has it: a sign between two letters, a marked capital after a small
  letter, a letter of another script inside a Latin word;
* lost: U+FFFD and C1 control characters, which only a wrong decoding leaves behind.

One pass of the automaton gives all multi-byte spans; only they are replaced, and of single-byte damage only the words
that hold it, so correct text in the same document stays as it is. Quoted letters (“Ã”), capitals before a closing
quote, words in other scripts, soft hyphens, ± ½ ° £ © between blanks are not matches.

Scale: a narrow map over Arrow batches, no shuffle; texts without a single character that can begin a match skip the
automaton.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Wrong encodings of UTF-8 bytes, in order of precedence where two give the same sequence.
WRONG = ("cp1252", "latin-1", "mac_roman", "cp437", "cp850", "cp1251", "koi8_r", "cp1250", "cp852", "cp866", "iso8859_2", "iso8859_15", "cp1254", "cp1257", "cp1253", "cp932")
#: (true, wrong) single-byte pairs in order of precedence.
SINGLE = (
    ("cp1252", "mac_roman"), ("cp1252", "cp850"), ("cp1252", "cp437"), ("cp1250", "cp1252"), ("iso8859_2", "cp1252"), ("cp1252", "cp1251"), ("cp1252", "koi8_r"),
    ("mac_roman", "cp1252"), ("cp850", "cp1252"), ("cp437", "cp1252"), ("cp852", "cp1252"), ("cp1250", "mac_roman"), ("cp1250", "cp852"), ("cp852", "cp1250"), ("cp1250", "cp1251"), ("cp1252", "cp1250"), ("mac_latin2", "cp1252"),
)

LATIN = "".join(chr(c) for c in range(0xC0, 0x180) if chr(c).isalpha())
SIGNS = "".join(map(chr, range(0xA0, 0xC0))) + "–—‘’‚“”„…€™•‹›†‡‰−×÷​   "
OTHER = "".join(map(chr, [*range(0x391, 0x3CA), *range(0x410, 0x452)]))

_BACK = {b: bytes([b]).decode("cp1252", errors="replace") for b in range(128, 256)}
_BACK = {b: (c if c != "�" else chr(b)) for b, c in _BACK.items()}


def _decode(data: bytes, wrong: str) -> str | None:
    if wrong == "cp1252":  # bytes that it does not define stay as control characters
        return "".join(chr(b) if b < 128 else _BACK[b] for b in data)
    try:
        return data.decode(wrong)
    except UnicodeDecodeError:
        return None


def _plain_letters(seq: str) -> bool:
    return all(c.isalpha() and c not in "ªºµƒ" for c in seq)


def _script(c: str) -> int:
    return 0 if ord(c) < 0x370 else 1 if ord(c) < 0x400 else 2 if ord(c) < 0x530 else 3


def _natural(seq: str) -> bool:
    """Letters that a correct word could hold: one script, no capital after a small letter, not three marked capitals' worth of signs."""
    if not _plain_letters(seq) or len({_script(c) for c in seq}) > 1 or any(a.islower() and b.isupper() for a, b in zip(seq, seq[1:])):
        return False
    return not seq.startswith("ÔÇ")


def sequences() -> dict[str, tuple[str, str]]:
    """Garbled sequence -> (character, kind); kind "sure"; "mixed" if it counts only next to Latin letters or another match; "marked" if it could be part of a word, so that it counts only after a small letter or in a text with another match."""
    out: dict[str, tuple[str, str]] = {}
    for wrong in WRONG:
        for ch in LATIN + SIGNS + OTHER:
            seq = _decode(ch.encode("utf-8"), wrong)
            if seq is None or len(seq) < 2 or seq == ch:
                continue
            again = [_decode(seq.encode("utf-8"), w) for w in ("cp1252", "latin-1") if wrong in ("cp1252", "latin-1")]
            for s, double in [(seq, False), *((a, True) for a in again if a)]:
                kind = "sure"
                if _natural(s) and not double:
                    # Latin capitals before a letter of another alphabet are sure; pure Cyrillic or Greek words are not.
                    kind = "sure" if s[0] in "ÃÂÅÄÐÑ" and s[1] in "šœžŸŠŒŽƒ" else "mixed" if ord(s[0]) >= 0x370 else "marked"
                out.setdefault(s, (ch, kind))
    for ch in LATIN + SIGNS:
        raw = ch.encode("utf-8")
        try:
            seq = raw.decode("gbk")
        except UnicodeDecodeError:
            continue
        out.setdefault(seq, (ch, "mixed"))
    # Signs of three bytes leave their last byte to the letter that follows.
    for ch in "–—‘’‚“”„…€":
        for letter in map(chr, range(0x40, 0x7B)):
            seq = (ch + letter).encode("utf-8").decode("gbk", errors="replace")
            if "�" not in seq and len(seq) == 2:
                out.setdefault(seq, (ch + letter, "sure"))
    return out


_SEQ: dict = {}


def _automaton():
    if not _SEQ:
        import ahocorasick

        table = sequences()
        auto = ahocorasick.Automaton()
        for s, (ch, kind) in table.items():
            auto.add_word(s, (len(s), ch, kind))
        auto.make_automaton()
        _SEQ["auto"] = auto
        _SEQ["first"] = frozenset(s[0] for s in table)
        singles: dict[tuple[str, str], dict[str, str]] = {}
        signs: dict[tuple[str, str], dict[str, str]] = {}
        for true, wrong in SINGLE:
            m, signs[(true, wrong)] = {}, {}
            for ch in LATIN + "–—‘’‚“”„…€™•‹›«»":
                try:
                    got = ch.encode(true).decode(wrong)
                except UnicodeError:
                    continue
                if got != ch and not got.isascii():
                    (m if ch.isalpha() else signs[(true, wrong)])[got] = ch
            singles[(true, wrong)] = m
        # letters decide what is a match; signs of the same pair are put right along with them
        _SEQ["singles"] = {p: {**signs[p], **m} for p, m in singles.items()}
        every = {c for m in singles.values() for c in m}
        between = "".join(sorted(c for c in every if not c.isalpha() and c not in "\xad\xa0’‘“”…–—«»•ªº˜" and not "\u0080" <= c <= "\u009f"))
        capitals = "".join(sorted(c for c in every if c.isalpha() and c.isupper() and ord(c) < 0x250))
        _SEQ["signs"] = re.compile(
            rf"(?<=[A-Za-zÀ-ÖØ-öø-ÿ])[{re.escape(between)}](?=[A-Za-zÀ-ÖØ-öø-ÿ])|(?<=[A-Za-z])[─-╿▀-▟]|[─-╿▀-▟](?=[A-Za-z])|(?<=\d )[ÇÄЂ](?!\w)|(?<=\s)[ûñ](?=\s)|(?<!\w)[¶¼¦¯³¹˙¸‰](?=[a-z]{{2}})|â(?=[¦¬])|(?<=[a-zß-öø-ÿ])[{capitals}](?=[a-zß-öø-ÿ]|[^\w]|$)|(?<=[A-Za-z])[Ѐ-ӿͰ-Ͽ](?=[a-z])|(?<![\w])[Ѐ-ӿͰ-Ͽ](?=[a-z]{{2}})|(?<=[a-z]{{2}})[Ѐ-ӿͰ-Ͽ](?![\w])"
        )
        _SEQ["suspect"] = frozenset(between) | frozenset(capitals) | frozenset(map(chr, [*range(0x370, 0x500), *range(0x2500, 0x25A0)])) | frozenset("ûñÇÄâ¦¬")
    return _SEQ


WIDE = re.compile("[\u2000-\u200f\u2028-\u202e\u2060-\u20ff\u2c00-\ud7ff\ue000-\uf8ff\uf900-\ufffc]{4,}")


def _wide(text: str) -> list[tuple[int, int, str]]:
    """(start, end, restored) of runs that are bytes of ordinary text read as UTF-16."""
    out = []
    for m in WIDE.finditer(text):
        for order in ("utf-16-le", "utf-16-be"):
            back = m.group().encode(order, errors="ignore").decode("utf-8", errors="replace")
            if sum(c.isascii() and (c.isalpha() or c in " .,") for c in back) >= 0.6 * len(back):
                out.append((m.start(), m.end(), back))
                break
    return out


OPENING, CLOSING = "“‘„«‹\"'(", "”’“»›"
LOST = re.compile("[�\u0080-\u009f]")
WORD = re.compile(r"\S+")


def _latin(c: str) -> bool:
    return c.isalpha() and ord(c) < 0x250


def spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, character) of the multi-byte matches, longest first at each place, without overlaps."""
    s = _automaton()
    best: dict[int, tuple[int, str, str]] = {}
    for end, (n, ch, kind) in s["auto"].iter(text):
        start = end - n + 1
        if start not in best or best[start][0] < n:
            best[start] = (n, ch, kind)
    found: list[tuple[int, int, str, str]] = []
    at = 0
    for start in sorted(best):
        if start < at:
            continue
        n, ch, kind = best[start]
        found.append((start, start + n, ch, kind))
        at = start + n
    ends, starts = {e for _, e, _, _ in found}, {b for b, _, _, _ in found}
    out = []
    sure_mixed = False
    waiting, marked = [], []
    for b, e, ch, kind in found:
        before, after = text[b - 1 : b], text[e : e + 1]
        if kind == "marked":
            if text[b].isupper() and (before.islower() or (after.islower() and before == "")):
                out.append((b, e, ch))
            else:
                marked.append((b, e, ch))
        elif kind == "sure":
            last = text[e - 1]
            if e - b == 2 and last in CLOSING + "…–—" and (before in OPENING and before or before.isupper()):
                continue
            out.append((b, e, ch))
        elif (before and _latin(before)) or (after and _latin(after)) or (before and b in ends and b - 1 >= 0 and text[b - 1] == "�"):
            out.append((b, e, ch))
            sure_mixed = True
        else:
            waiting.append((b, e, ch, b in ends or e in starts))
    out += [(b, e, ch) for b, e, ch, joined in waiting if joined and sure_mixed or sure_mixed and e - b == 1 and not text[b - 1 : b].isalpha() and not text[e : e + 1].isalpha()]
    firsts = {text[b] for b, _, _ in out}
    out += [(b, e, ch) for b, e, ch in marked if text[b] in firsts]
    return sorted(out)


#: Letters of Russian and Greek from the most to the least frequent: fixed values.
FREQUENT = ("оеаинтсрвлкмдпуяыьгзбчйхжшюцщэфъё", "αοιετσνηυρπκμλςωδγχθφβξζψόίάέήύώϊϋ")
VOWELS = frozenset("оеаиуяыюэёαοιεηυωόίάέήύώ")
ACCENTED = re.compile(r"(?<![A-Za-z])[À-ÖØ-öø-ÿ]{2,}(?![A-Za-z])|(?<=[ ])[à-öø-ÿ](?=[ ])")
CYRILLIC = re.compile("[Ѐ-ӿ]+")
ACCENTED3 = re.compile(r"[À-ÖØ-öø-ÿ]{3}")
INVERTED = re.compile("[а-яё][А-ЯЁ]{2}")
FOREIGN = re.compile("[^\x00-\x7f]+(?: [^\x00-\x7f]+)*")


def _familiar(word: str) -> float:
    """How much a word looks like one of a language: mean rank of its letters, 0 for cases or letters that no word has."""
    low = word.lower()
    if not (word == low or word[1:] == low[1:] or word.isupper()):
        return 0.0
    return max(sum((len(f) - f.index(c)) / len(f) if c in f else -1.0 for c in low) / len(low) for f in FREQUENT)


def _whole_words(text: str, pattern: re.Pattern, read_as: str, written_in: tuple[str, ...], least: float) -> list[tuple[int, int, str]]:
    """(start, end, restored) of words all of whose letters were read as `read_as`; one encoding for the text, told by its longer words."""
    words = [m for m in pattern.finditer(text)]
    long = [m.group() for m in words if len(m.group()) >= 4]
    if len(long) < 3 or sum(map(len, long)) < 12:  # a single word may be a row of letters of the alphabet
        return []
    best, chosen = least, None
    for enc in written_in:
        try:
            back = [w.encode(read_as).decode(enc) for w in long]
        except UnicodeError:
            continue
        if min(sum(c.lower() in VOWELS for c in b) / len(b) for b in back) < 0.2:
            continue
        score = sum(_familiar(b) * len(b) for b in back) / sum(map(len, back))
        if score > best and min(map(_familiar, back)) > 0:
            best, chosen = score, enc
    if chosen is None:
        return []
    out = []
    for m in words:
        try:
            out.append((m.start(), m.end(), m.group().encode(read_as).decode(chosen)))
        except UnicodeError:
            continue
    return out


def _runs(text: str) -> list[tuple[int, int, str]]:
    """(start, end, restored) of runs of foreign characters that are, as bytes of a wrong encoding, UTF-8 of two letters or more of one script."""
    out = []
    for m in FOREIGN.finditer(text):
        run = m.group()
        if len(run) < 4:
            continue
        for wrong in ("cp1251", "koi8_r", "cp866", "cp1253", "cp932", "gbk", "euc_kr", "big5"):
            try:
                back = run.encode(wrong).decode("utf-8")
            except UnicodeError:
                continue
            letters = [c for c in back if not c.isspace()]
            if 2 <= len(letters) < len(run) and all(c.isalpha() for c in letters) and len({_script(c) for c in letters}) == 1 and _script(letters[0]) < 3:
                out.append((m.start(), m.end(), back))
                break
    return out


def _put(text: str, found: list[tuple[int, int, str]]) -> str:
    parts, at = [], 0
    for b, e, back in found:
        parts += [text[at:b], back]
        at = e
    return "".join([*parts, text[at:]])


def examine(text: str | None) -> tuple[int, int, str | None]:
    """(spans found, spans that can't be restored, restored text) of one text."""
    if not text or text.isascii():
        return 0, 0, text
    s = _automaton()
    chars = set(text)
    n = lost = 0
    if max(text) >= "\u2c00":
        wide = _wide(text)
        n += len(wide)
        for b, e, back in reversed(wide):
            lost += back.count("�")
            text = text[:b] + back.replace("�", "") + text[e:]
    if any("\u0370" <= c < "\u2000" or c >= "\u2500" for c in chars):
        found = _runs(text)
        if not found and INVERTED.search(text):
            found = _whole_words(text, CYRILLIC, "cp1251", ("koi8_r",), 0.55)
        n += len(found)
        text = _put(text, found)
    if sum("À" <= c <= "ÿ" for c in chars) >= 4 and ACCENTED3.search(text):
        found = _whole_words(text, ACCENTED, "cp1252", ("cp1251", "koi8_r", "cp1253", "cp866"), 0.55)
        n += len(found)
        text = _put(text, found)
    if n:
        chars = set(text)
    if chars & s["first"]:
        hits = spans(text)
        if hits:
            n += len(hits)
            parts, at = [], 0
            for b, e, ch in hits:
                parts += [text[at:b], ch]
                at = e
            text = "".join([*parts, text[at:]])
            if any(ord(c[0]) >= 0xC0 for _, _, c in hits) and set(text) & s["first"]:
                more = spans(text)  # a third decoding
                if more:
                    parts, at = [], 0
                    for b, e, ch in more:
                        parts += [text[at:b], ch]
                        at = e
                    text = "".join([*parts, text[at:]])
            chars = set(text)
    gone = LOST.findall(text) if "�" in chars or any("\u0080" <= c <= "\u009f" for c in chars) else []
    lost += len(gone)
    if chars & s["suspect"]:
        marks = [m.start() for m in s["signs"].finditer(text)]
        marks = [i for i in marks if not (text[i] == "·" and text[i - 1 : i] == "l" and text[i + 1 : i + 2] == "l")]
        if marks:
            n += len(marks)
            count = Counter(text[i] for i in marks)
            # one pair for the text as far as it goes; a mark it does not explain takes another that explains two marks at least
            score = {pair: sum(k for c, k in count.items() if c in m) for pair, m in s["singles"].items()}
            order = sorted(score, key=lambda p: (-score[p], SINGLE.index(p)))
            of = {c: next((p for p in order if c in s["singles"][p] and (p == order[0] or score[p] > 1)), None) for c in count}
            lost += sum(k for c, k in count.items() if of[c] is None)
            hit = iter(sorted(marks))
            nxt = next(hit, None)
            parts, at = [], 0
            for w in WORD.finditer(text):
                if nxt is None:
                    break
                if nxt < w.end():
                    here = []
                    while nxt is not None and nxt < w.end():
                        here.append(nxt)
                        nxt = next(hit, None)
                    # the letters of a word were misread together: those of the pairs of its marks are put right, others stay
                    pairs = {of[text[i]] for i in here} - {None}
                    m = {c: x for p in pairs for c, x in s["singles"][p].items()}
                    parts += [text[at : w.start()], "".join(m.get(c, c) for c in w.group())]
                    at = w.end()
            text = "".join([*parts, text[at:]])
    return n + len(gone), lost, text


def repair(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_spans, n_lost, restored) of every row whose text holds a garbled sequence.

    Null and empty texts have none. Repeated rows come out as often as they go in; other columns are ignored. Very long
    texts are read whole. A text with lost characters comes out too, restored as far as possible (n_lost > 0).
    """

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            got = [(k, *r) for k, t in zip(pdf["_k"], pdf["_t"]) for r in [examine(t)] if r[0]]
            yield pd.DataFrame(got, columns=["_k", "n_spans", "n_lost", "restored"])

    kind = docs.schema[key].dataType.simpleString()
    out = docs.select(F.col(key).alias("_k"), F.col(text).alias("_t")).where("length(_t) > 0").mapInPandas(scan, f"_k {kind}, n_spans int, n_lost int, restored string")
    return out.withColumnRenamed("_k", key)
