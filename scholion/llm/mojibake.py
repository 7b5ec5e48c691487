"""Text decoded with the wrong character encoding: found and, where possible, restored (problem 5).

Round-trip repair: the text is written back under a candidate legacy encoding and strictly decoded under the
intended one; nested damage is undone by repeating this; a repair is accepted when the garbling cost drops. The
cost counts characters that do not occur in sound text (controls, replacement characters, remains of multi-byte
sequences) and letters or signs at places where no script puts them. Passages are handled one by one, so sound
foreign words beside a damaged passage stay as they are. Damage that lost its bytes cannot be undone; it still
counts as found.

Defined results: null and empty fields are neither found nor changed; very long texts are read whole, passage by
passage; repeated rows give the same answer and are reported once; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable, Iterator, Sequence
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FIELDS = ("title", "abstract", "full_text")

#: Encodings a text may have been read under by mistake, with the one it was written in.
PAIRS: tuple[tuple[str, str], ...] = (
    ("latin-1", "utf-8"),
    ("cp1252", "utf-8"),
    ("cp1251", "utf-8"),
    ("cp1250", "utf-8"),
    ("cp1253", "utf-8"),
    ("cp1254", "utf-8"),
    ("cp437", "utf-8"),
    ("cp850", "utf-8"),
    ("cp866", "utf-8"),
    ("koi8-r", "utf-8"),
    ("mac_roman", "utf-8"),
    ("gb18030", "utf-8"),
    ("big5", "utf-8"),
    ("shift_jis", "utf-8"),
    ("euc_kr", "utf-8"),
    ("latin-1", "gb18030"),
    ("cp1252", "gb18030"),
    ("mac_roman", "cp1252"),
    ("cp1251", "cp1252"),
    ("cp437", "cp1252"),
    ("cp850", "cp1252"),
    ("cp1253", "cp1252"),
    ("koi8-r", "cp1252"),
    ("cp1252", "mac_roman"),
    ("cp1252", "cp437"),
    ("cp1252", "cp850"),
    ("cp1252", "cp1251"),
    ("latin-1", "cp1251"),
)
_WIDE = {"gb18030", "big5", "shift_jis", "euc_kr"}


def _sloppy(byte: int, encoding: str) -> str | None:
    """The character of a byte; bytes that the code page leaves open become the control of that number."""
    try:
        return bytes([byte]).decode(encoding)
    except UnicodeDecodeError:
        return chr(byte)


@lru_cache(None)
def _to_bytes(encoding: str) -> dict[int, int]:
    """Character to byte, for the single-byte encodings."""
    return {ord(_sloppy(b, encoding)): b for b in range(256) if len(_sloppy(b, encoding)) == 1}


def _encode(text: str, encoding: str) -> bytes | None:
    if encoding in _WIDE:
        try:
            return text.encode(encoding)
        except UnicodeEncodeError:
            return None
    table = _to_bytes(encoding)
    out = bytearray()
    for c in map(ord, text):
        b = table.get(c)
        if b is None:
            if c < 256 and (c < 128 or c > 127 and c < 160):
                b = c
            else:
                return None
        out.append(b)
    return bytes(out)


def _classes(encoding: str) -> tuple[str, str, str, str]:
    """Character classes of UTF-8's lead bytes (2, 3, 4 long) and continuation bytes as read under an encoding."""
    make = lambda lo, hi: "".join(re.escape(_sloppy(b, encoding)) for b in range(lo, hi + 1))
    return make(0xC2, 0xDF), make(0xE0, 0xEF), make(0xF0, 0xF4), make(0x80, 0xBF)


@lru_cache(None)
def _utf8_run(encoding: str) -> re.Pattern:
    two, three, four, rest = _classes(encoding)
    return re.compile(f"(?:[{two}][{rest}]|[{three}][{rest}]{{2}}|[{four}][{rest}]{{3}})+")


#: Characters a repair may give: scripts and signs in use, so that a quotation mark and a capital never pass for one letter.
_PLAUSIBLE = re.compile("[\u0080-\u024f\u02b0-\u036f\u0370-\u03ff\u0400-\u045f\u0490\u0491\u1e00-\u1fff\u2000-\u22ff\u2460-\u27bf\u2e80-\u30ff\u3100-\u9fff\uac00-\ud7a3\ufe30-\ufe4f\uff00-\uffef\ufffd\ufeff\U0001f000-\U0001faff\U00020000-\U0002ffff]+")
_RUSSIAN = re.compile("[а-я]{4,}")
_SINGLE_TO_UTF8 = tuple(e for e, to in PAIRS if to == "utf-8" and e not in _WIDE)
#: Characters that only damage leaves in a text of this kind: C1 controls, the replacement character, private use.
_LOST = re.compile("[\u0080-\u009f\ufffd\ue000-\uf8ff]|锟斤|斤拷|ï¿½|п»ї|ï»¿|烫烫|屯屯")
#: A question mark where a letter was: inside a word, or before one that goes on in small letters.
_QUESTIONED = re.compile(r"[^\W\d_]\?{1,3}[^\W\d_]|(?<![\w?/&=.:#+%])\?{1,3}(?=[a-zà-ÿ]{3})|(?<=[a-z]) \?(?=\d)|(?<=[a-z(]) \?{1,9} (?=[=\d]|[a-z]{2})|(?<!\S)\?{5,}(?= )")
_URL = re.compile(r"\S*(?:https?:|www\.|[?&]\w+=)\S*")

_LATIN_WORD = re.compile(r"[^\W\d_]+")
_SIGN_IN_WORD = re.compile(r"[A-Za-z][¡¢£¤¥¦§¨©ª«¬®¯°±²³´¶¸¹º»¼½¾¿×÷ˆ˜‚„†‡•‹›€™‰∞∂∑∏π∫Ω√≈∆◊ﬁﬂı˘˙˚˝˛ˇ⁄·─-▟⌐ⁿ∙⌠⌡₧]+[a-z]")
#: Signs and letters at places that no script gives them: a sign or an opening letter before a word, a capital after a ligature.
_ODD_PLACE = re.compile(r"(?<!\S)[¬¸ˆ˘˙˚˝˛ˇ‹›√≈][a-z]|(?<!\w)[ìëí][A-ZÀ-Þﬁﬂ‹”≈]|[ﬁﬂ][À-ÖØ-Þ]|[A-Z][√¬∂∆≈][A-Z]|(?<!\w)[ЈЃЅІЇЎҐ]\d|\d ?∞C\b")
_UPPER_IN_WORD = re.compile(r"[a-zß-öø-ÿ][À-ÖØ-Þ](?![A-ZÀ-Þ]{2})")
_BOX = re.compile("[─-▟⌐⌠⌡₧]")


def _script(c: str) -> str:
    n = ord(c)
    if n < 0x250:
        return "L"
    if 0x370 <= n < 0x400:
        return "G"
    if 0x400 <= n < 0x530:
        return "C"
    if 0x3040 <= n < 0xA000 or 0xAC00 <= n < 0xD7A4:
        return "H"
    return "O"


def surface(text: str) -> int:
    """The part of the garbling cost that single characters and their neighbours show."""
    total = 3 * len(_LOST.findall(text)) + 2 * len(_BOX.findall(text))
    total += 2 * (len(_SIGN_IN_WORD.findall(text)) + len(_UPPER_IN_WORD.findall(text)) + len(_ODD_PLACE.findall(text)))
    for w in _LATIN_WORD.findall(text):
        if not w.isascii() and len({s for s in map(_script, w) if s in "LGC"}) > 1:
            total += 2 * sum(_script(c) in "GC" for c in w)
    return total


def cost(text: str) -> int:
    """The garbling cost of a text, nought for sound text: what its surface shows and the characters that are remains of longer sequences."""
    return surface(text) + sum(removed for _, removed in _decoded(text))


def _decoded(text: str) -> list[tuple[str, int]]:
    """What each way of decoding runs of remains gives, and how many characters of the text are such remains."""
    return [_han_repair(text), _utf8_repair(text), _wide_repair(text)]


def _utf8_repair(text: str) -> tuple[str, int]:
    """Every run that strictly decodes as UTF-8 under one of the single-byte encodings, decoded; longest gain first."""
    best, gain = text, 0
    russian = _RUSSIAN.search(text) is not None
    for e in _SINGLE_TO_UTF8:
        if russian and e in ("cp1251", "koi8-r", "cp866"):
            continue
        runs = [0]

        def back(m: re.Match, e: str = e, runs: list = runs) -> str:
            raw = _encode(m.group(), e)
            try:
                out = raw.decode("utf-8") if raw is not None else None
            except UnicodeDecodeError:
                out = None
            if out is None or not _PLAUSIBLE.fullmatch(out):
                return m.group()
            runs[0] += len(m.group()) - len(out)
            return out

        new = _utf8_run(e).sub(back, text)
        if runs[0] > gain:
            best, gain = new, runs[0]
    return best, gain


def _single_repair(text: str) -> str:
    """The whole passage under the single-byte pairs and the wide ones, if the cost drops."""
    best, least = text, surface(text)
    if not least and not any(" " <= c for c in text):
        return text
    for wrong, right in PAIRS:
        if right == "utf-8" and wrong not in _WIDE:
            continue
        if wrong in _WIDE or right in _WIDE:
            continue
        raw = _encode(text, wrong)
        if raw is None:
            continue
        try:
            new = raw.decode(right)
        except UnicodeDecodeError:
            continue
        now = surface(new)
        if now < least:
            best, least = new, now
    return best


_HAN_RUN = re.compile("[㐀-鿿＀-￯　-〿€]+")
_HIGH_RUN = re.compile("[\u0080-\u00ff]{4,}")


def _wide_repair(text: str) -> tuple[str, int]:
    """UTF-8 read as a two-byte encoding: runs of rare Han."""
    removed = [0]

    def back(m: re.Match) -> str:
        for e in ("gb18030", "big5", "shift_jis", "euc_kr"):
            try:
                out = m.group().encode(e).decode("utf-8")
            except (UnicodeEncodeError, UnicodeDecodeError):
                continue
            if len(out) < 2 * len(m.group()) and all(unicodedata.category(c)[0] in "LNPSZM" for c in out):
                removed[0] += len(m.group())
                return out
        return m.group()

    if _HAN_RUN.search(text):
        text = _HAN_RUN.sub(back, text)
    return text, removed[0]


def _han_repair(text: str) -> tuple[str, int]:
    """Two-byte text read as Latin: runs of high characters that are no UTF-8 as a whole but Han throughout."""
    removed = [0]

    def han(m: re.Match) -> str:
        try:
            m.group().encode("latin-1").decode("utf-8")
            return m.group()
        except UnicodeDecodeError:
            pass
        if min(m.group()) < "\u00a1":
            return m.group()
        for e in ("gb18030", "big5", "euc_kr"):
            try:
                out = m.group().encode("latin-1").decode(e)
            except (UnicodeEncodeError, UnicodeDecodeError):
                continue
            if all("　" <= c <= "鿿" or "＀" <= c <= "￯" or c in "“”‘’…—·" for c in out):
                removed[0] += len(m.group())
                return out
        return m.group()

    if _HIGH_RUN.search(text):
        text = _HIGH_RUN.sub(han, text)
    return text, removed[0]


def restore(passage: str, layers: int = 4) -> tuple[str, bool]:
    """The restored passage, and whether it was found damaged."""
    if passage.isascii():
        bad = "?" in passage and bool(_QUESTIONED.search(_URL.sub(" ", passage)))
        return passage, bad
    text, found = passage, False
    for _ in range(layers):
        tries = _decoded(text)
        now = surface(text) + sum(removed for _, removed in tries)
        new = next((t for t, _ in tries if t != text), None) or _single_repair(text)
        # One gate for every pair: what was decoded is kept if the cost drops.
        if new == text or cost(new) >= now:
            break
        text, found = new, True
    if not found:
        found = now > 0 or bool(_LOST.search(passage))
    if not found and "?" in passage:
        found = bool(_QUESTIONED.search(_URL.sub(" ", passage)))
    return text, found


#: Passages end at sentence ends and lines; a damaged passage never hides in a sound one.
_PASSAGE = re.compile(r"[^\n]+?(?:(?<![\s?(])[.!?;。！？；](?=\s)|$|\n)", re.M)
_SUSPECT = re.compile(r"[^\x00-\x7f]|[^\W\d_]\?{1,3}[^\W\d_]|(?<![\w?])\?{1,3}[a-z]{3}| \?|\?{5}")


def garbled(text: str | None, known: dict | None = None) -> bool:
    """Whether any passage of a field is damaged."""
    if not text or not _SUSPECT.search(text):
        return False
    for m in _PASSAGE.finditer(text):
        p = m.group()
        if p.isascii() and "?" not in p:
            continue
        if known is None:
            hit = restore(p, 1)[1]
        else:
            key = _key(p)
            hit = known.get(key)
            if hit is None:
                hit = restore(p, 1)[1]
                if len(known) < 20_000:
                    known[key] = hit
        if hit:
            return True
    return False


_DIGITS = re.compile(r"\d+")
_ASCII_RUN = re.compile(r"[\x00-\x3e\x40-\x7f]{12,}")


def _key(passage: str) -> str:
    """The damaged or foreign parts of a passage with their neighbours; long plain stretches do not matter."""
    return _DIGITS.sub("0", _ASCII_RUN.sub(lambda m: m.group()[:3] + "\0" + m.group()[-3:], passage))


def repair_text(text: str | None) -> str | None:
    """The text with every passage restored that can be."""
    if not text or text.isascii():
        return text
    return _PASSAGE.sub(lambda m: m.group() if m.group().isascii() else restore(m.group())[0], text)


def find_garbled(records: DataFrame, id_col: str = "record_id", fields: Sequence[str] = FIELDS) -> DataFrame:
    """One row ``record_id, field`` for each field with a damaged passage. One pass over the table, no shuffle but for repeated ids."""
    names = list(fields)

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict = {}
        for b in batches:
            ids = b.column(0).to_pylist()
            out_id, out_field = [], []
            for k, name in enumerate(names, 1):
                for i, text in zip(ids, b.column(k).to_pylist()):
                    if text and garbled(text, known):
                        out_id.append(i)
                        out_field.append(name)
            yield pa.RecordBatch.from_arrays([pa.array(out_id, pa.int64()), pa.array(out_field, pa.string())], names=["record_id", "field"])

    picked = records.select(F.col(f"`{id_col}`").cast("long").alias("record_id"), *[F.col(f"`{c}`").alias(f"__f{i}") for i, c in enumerate(names)])
    return picked.mapInArrow(scan, "record_id long, field string").distinct()


def repair(records: DataFrame, fields: Sequence[str] = FIELDS) -> DataFrame:
    """The table with the named fields restored; all other columns and rows as they were."""

    @F.pandas_udf("string")
    def back(texts):
        return texts.map(repair_text)

    return records.withColumns({c: back(F.col(f"`{c}`")) for c in fields})
