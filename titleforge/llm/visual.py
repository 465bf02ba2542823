"""Problem 5: text that looks alike is brought to one form.

Arrow text is copied to numpy code-point arrays; lookup tables give each point's decomposition
(expansion lengths and offsets), its role and its plain counterpart; words and kana runs are
labelled by segment sums; marks are composed by a sorted pair table. No step calls a string
method on a row."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from titleforge.llm.codepoints import SIZE, from_codepoints, keep, row_of, to_codepoints

# Letters of other scripts and the Latin letters they look like.
LOOKALIKE_LETTERS = {
    "А": "A", "В": "B", "С": "C", "Е": "E", "Н": "H", "І": "I", "Ј": "J", "К": "K", "М": "M", "О": "O", "Р": "P", "Ѕ": "S", "Т": "T", "Х": "X", "У": "Y", "Ү": "Y", "Ԛ": "Q", "Ԝ": "W", "Ӏ": "I", "Ԍ": "G",
    "а": "a", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "о": "o", "р": "p", "ԛ": "q", "ѕ": "s", "ѵ": "v", "ԝ": "w", "х": "x", "у": "y", "ӏ": "l",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "ο": "o", "ν": "v", "ϲ": "c", "Ϲ": "C", "ϳ": "j",
    "Օ": "O", "Ս": "U", "օ": "o", "ս": "u", "հ": "h", "ո": "n", "ց": "g", "զ": "q", "Ꭺ": "A", "Ᏼ": "B", "Ꮯ": "C", "Ꭰ": "D", "Ꭼ": "E", "Ꮋ": "H", "Ꭻ": "J", "Ꮶ": "K", "Ꮮ": "L", "Ꮇ": "M", "Ꮲ": "P", "Ꭱ": "R", "Ꮪ": "S", "Ꭲ": "T", "Ꮩ": "V", "Ꮃ": "W", "Ꮓ": "Z",
}
#: Of these only a word that also holds Latin letters is taken for Latin: alone they are symbols.
MIXED_ONLY = {"α": "a", "ρ": "p", "κ": "k", "ι": "i", "τ": "t", "υ": "u", "γ": "y", "η": "n", "ω": "w", "χ": "x", "т": "t", "в": "b", "к": "k", "м": "m", "н": "h", "п": "n", "г": "r", "ɑ": "a", "ɡ": "g", "ı": "i", "ɩ": "i"}
# Radicals without a decomposition and the characters they look like.
RADICALS = dict(zip(
    "⺁⺄⺅⺆⺈⺉⺊⺌⺎⺏⺐⺑⺒⺓⺔⺖⺗⺘⺙⺛⺜⺝⺡⺣⺤⺥⺦⺧⺩⺪⺫⺬⺭⺮⺯⺰⺱⺶⺷⺸⺹⺺⺼⺽⺾⺿⻀⻁⻂⻃⻄⻅⻆⻇⻈⻉⻊⻋⻌⻍⻎⻏⻐⻑⻒⻓⻔⻕⻖⻗⻘⻙⻚⻛⻜⻝⻞⻟⻠⻡⻢⻣⻤⻥⻦⻧⻨⻩⻪⻫⻬⻭⻮⻯⻰⻱⻲",
    "厂乙亻冂刀刂卜小兀尣尢尣巳幺彑忄心扌攵旡日月氵灬爫爫丬牛王疋目示礻竹糹纟罓羊羊羋耂肀月臼艹艹艹虎衤覀西见角角讠贝足车辶辶辶邑钅長镸长门阜阝雨青韦页风飞食飠飠饣首马骨鬼鱼鸟卤麦黄黾斉齐歯齿竜龙龟亀",
))
# Kana and Bopomofo that look like Han characters, taken for them next to a Han character.
HAN_LIKE = {"ロ": "口", "エ": "工", "カ": "力", "ニ": "二", "ハ": "八", "タ": "夕", "チ": "千", "ト": "卜", "ミ": "彡", "ヒ": "匕", "ー": "一", "ノ": "丿", "ㄚ": "丫", "ㄠ": "幺", "ㄡ": "又", "ㄙ": "厶", "ㄏ": "厂", "ㄦ": "儿", "ㄇ": "冂", "ㄈ": "匚"}

LATIN, LOOKS, MIXED, LETTER, DIGIT, MARK, HAN, KANA, KANA_LIKE, INVISIBLE, SPACE, EMOJI, TONE, JOINER, SELECTOR, STANDS, WIDE = (1 << k for k in range(17))


class Tables(NamedTuple):
    length: np.ndarray  # points in the decomposition of each point
    start: np.ndarray  # where it begins in `points`
    points: np.ndarray
    role: np.ndarray
    plain: np.ndarray  # the counterpart by sight
    ccc: np.ndarray  # canonical combining class
    pair: np.ndarray  # sorted first << 21 | second
    composed: np.ndarray


def _unfold(c: int) -> str:
    """The full canonical decomposition of a point, or the plain form of a width, radical, font or compatibility variant."""
    ch = chr(c)
    tag = unicodedata.decomposition(ch)
    if 0xFF01 <= c <= 0xFFEE or tag.startswith("<font>") or 0x2E80 <= c <= 0x2FD5 or 0x24B6 <= c <= 0x24E9 or 0x1F130 <= c <= 0x1F149:
        return RADICALS.get(ch) or unicodedata.normalize("NFKD", ch)
    if 0xAC00 <= c <= 0xD7A3:  # Hangul syllables stay whole
        return ch
    return unicodedata.normalize("NFD", ch)


@lru_cache(1)
def tables() -> Tables:
    """All lookup tables, built from the Unicode data of the running Python."""
    length, start = np.ones(SIZE, np.int64), np.arange(SIZE, dtype=np.int64)
    role, plain, ccc = np.zeros(SIZE, np.int64), np.arange(SIZE, dtype=np.int64), np.zeros(SIZE, np.int64)
    extra, pairs = [], {}
    for c in range(SIZE):
        if 0xD800 <= c <= 0xDFFF:
            continue
        ch = chr(c)
        cat = unicodedata.category(ch)
        if cat in ("Cn", "Co"):
            continue
        ccc[c] = unicodedata.combining(ch)
        if (full := _unfold(c)) != ch:
            length[c], start[c] = len(full), SIZE + len(extra)
            extra.extend(map(ord, full))
        two = unicodedata.decomposition(ch).split()
        if len(two) == 2 and two[0][0] != "<" and unicodedata.normalize("NFC", ch) == ch:
            pairs[int(two[0], 16) << 21 | int(two[1], 16)] = c
        r = 0
        if cat[0] == "L":
            name = unicodedata.name(ch, "")
            r = LATIN | LETTER if name.startswith("LATIN") else HAN if name.startswith(("CJK UNIFIED", "CJK COMPAT")) or c == 0x3005 else LETTER
            if name.startswith(("KATAKANA", "HIRAGANA", "BOPOMOFO")) or c == 0x30FC:
                r = KANA | LETTER
        elif cat[0] == "N":
            r = DIGIT
        elif cat[0] == "M":
            r = MARK
        if cat == "Cf" or c in (0x180E, 0x034F, 0x115F, 0x1160, 0x3164, 0x17B4, 0x17B5, 0x2065) or 0xFE00 <= c <= 0xFE0F or 0xE0100 <= c <= 0xE01EF or 0x180B <= c <= 0x180D or (cat == "Cc" and c not in (9, 10, 11, 12, 13, 0x85)):
            r = INVISIBLE
        if cat == "Zs" and c != 32:
            r = SPACE
        if c in (0x00A9, 0x00AE, 0x203C, 0x2049, 0x2122, 0x2139) or cat == "So" and c >= 0x2190 and not 0x2E80 <= c <= 0x33FF or 0x1F000 <= c <= 0x1FAFF or 0x2190 <= c <= 0x21FF:
            r |= EMOJI
        if 0x1F3FB <= c <= 0x1F3FF:
            r |= TONE
        if c == 0x200D:
            r |= JOINER
        if c in (0xFE0E, 0xFE0F) or 0xE0020 <= c <= 0xE007F:
            r |= SELECTOR
        if 0xFF01 <= c <= 0xFF5E:
            r |= WIDE
        if full != ch and (0x2E80 <= c <= 0x2FD5 or 0xF900 <= c <= 0xFAFF or 0x2F800 <= c <= 0x2FA1F or unicodedata.decomposition(ch).startswith("<font>") or 0x24B6 <= c <= 0x24E9 or 0x1F130 <= c <= 0x1F149):
            r |= STANDS
        role[c] = r
    for table, flag in ((LOOKALIKE_LETTERS, LOOKS), (MIXED_ONLY, MIXED), (HAN_LIKE, KANA_LIKE)):
        for a, b in table.items():
            role[ord(a)] |= flag
            role[ord(a)] &= ~LATIN
            plain[ord(a)] = ord(b)
    keys = np.array(sorted(pairs), dtype=np.int64)
    points = np.concatenate([np.arange(SIZE, dtype=np.int64), np.array(extra, dtype=np.int64)])
    return Tables(length, start, points, role, plain, ccc, keys, np.array([pairs[k] for k in keys.tolist()], dtype=np.int64))


def _beside(values: np.ndarray, row: np.ndarray, step: int) -> np.ndarray:
    """The value of the neighbour `step` away in the same row, or 0."""
    out = np.zeros_like(values)
    if step > 0:
        out[:-step][row[:-step] == row[step:]] = values[step:][row[:-step] == row[step:]]
    else:
        out[-step:][row[-step:] == row[:step]] = values[:step][row[-step:] == row[:step]]
    return out


def _emoji_parts(role: np.ndarray, points: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Joiners, selectors and tags that belong to an emoji sequence."""
    emoji, selector = (role & EMOJI) > 0, (role & SELECTOR) > 0
    part = np.zeros(len(role), bool)
    keycap = ((points >= 0x30) & (points <= 0x39)) | (points == 0x23) | (points == 0x2A)
    base = emoji | (keycap & ((_beside(points, row, 1) == 0x20E3) | ((_beside(points, row, 2) == 0x20E3) & _beside(selector, row, 1))))
    reach = base.copy()
    while True:  # as long as the longest run of selectors or tags
        more = selector & _beside(reach, row, -1) & ~reach
        if not more.any():
            break
        reach |= more
        part |= more
    joiner = ((role & JOINER) > 0) & _beside(reach, row, -1) & _beside(emoji, row, 1)
    return part | joiner


def _segments(inside: np.ndarray, row: np.ndarray) -> np.ndarray:
    """A number per run of `inside` points of one row, 0 outside runs."""
    begins = inside & ~(_beside(inside, row, -1))
    return np.cumsum(begins) * inside


def _any_in(segment: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """For each point: whether its segment holds a point under the mask."""
    if not len(segment):
        return np.zeros(0, bool)
    return (np.bincount(segment, weights=mask, minlength=1)[segment] > 0) & (segment > 0)


def _compose(points: np.ndarray, offsets: np.ndarray, t: Tables) -> tuple[np.ndarray, np.ndarray]:
    """Marks joined with their letters in canonical order, all rows at once."""
    ccc = t.ccc[points]
    if len(points) and (ccc > 0).any():
        row = row_of(offsets)
        falls = (ccc[1:] > 0) & (ccc[:-1] > ccc[1:]) & (row[1:] == row[:-1])
        if falls.any():
            run = np.cumsum((ccc == 0) | (np.concatenate([[True], row[1:] != row[:-1]])))
            order = np.lexsort((np.arange(len(points)), ccc, run))
            points, ccc = points[order], ccc[order]
        blocked = np.zeros(len(points), bool)
        while True:
            row, index = row_of(offsets), np.arange(len(points))
            starter = np.maximum.accumulate(np.where(ccc == 0, index, -1))
            marks = (ccc > 0) & (starter >= 0) & ~blocked
            marks &= row[np.maximum(starter, 0)] == row
            before = _beside(ccc, row, -1)
            free = marks & ((starter == index - 1) | (before < ccc))
            key = np.where(free, points[np.maximum(starter, 0)] << 21 | points, -1)
            at = np.minimum(np.searchsorted(t.pair, key), len(t.pair) - 1)
            hits = np.flatnonzero(t.pair[at] == key)
            if not len(hits):
                break
            first = hits[np.unique(starter[hits], return_index=True)[1]]
            points = points.copy()
            points[starter[first]] = t.composed[at[first]]
            stay = np.ones(len(points), bool)
            stay[first] = False
            points, offsets = keep(points, offsets, stay)
            ccc, blocked = ccc[stay], blocked[stay]
    # Hangul: leading consonant and vowel, then the final consonant.
    for first, second, form in (((0x1100, 0x1113), (0x1161, 0x1176), lambda a, b: 0xAC00 + ((a - 0x1100) * 21 + b - 0x1161) * 28), ((0xAC00, 0xD7A4), (0x11A8, 0x11C3), lambda a, b: a + b - 0x11A7)):
        if not len(points) or not ((points >= second[0]) & (points < second[1])).any():
            continue
        row = row_of(offsets)
        a = _beside(points, row, -1)
        hit = (points >= second[0]) & (points < second[1]) & (a >= first[0]) & (a < first[1]) & ((first[0] != 0xAC00) | ((a - 0xAC00) % 28 == 0))
        where = np.flatnonzero(hit)
        points = points.copy()
        points[where - 1] = form(points[where - 1], points[where])
        points, offsets = keep(points, offsets, ~hit)
    return points, offsets


def unify(points: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(points and offsets of the one form, per row whether it held a disguised sign)."""
    t = tables()
    rows = len(offsets) - 1
    row = row_of(offsets)
    role = t.role[points]
    bad = np.zeros(len(points), bool)
    part = _emoji_parts(role, points, row)
    hidden = ((role & INVISIBLE) > 0) & ~part
    bad |= hidden | ((role & (SPACE | WIDE | STANDS)) > 0)
    marked = (t.ccc[points] > 0) & (((points >= 0x300) & (points <= 0x36F)) | ((points >= 0x1AB0) & (points <= 0x1AFF)) | ((points >= 0x1DC0) & (points <= 0x1DFF)) | ((points >= 0xFE20) & (points <= 0xFE2F)) | (points == 0x3099) | (points == 0x309A))
    if marked.any():
        visible = np.flatnonzero(~hidden)
        under = np.zeros(len(points), bool)  # a letter lies under the mark
        r, m, k = row[visible], marked[visible], (role[visible] & (LETTER | HAN)) > 0
        base = np.maximum.accumulate(np.where(~m, np.arange(len(visible)), -1))
        under[visible] = m & (base >= 0) & (r[np.maximum(base, 0)] == r) & k[np.maximum(base, 0)]
        bad |= under
    flagged = np.bincount(row[bad], minlength=rows) > 0

    points, offsets = keep(np.where((role & SPACE) > 0, 32, points), offsets, ~hidden)
    part = part[~hidden]
    lengths, starts = t.length[points], t.start[points]
    before = np.concatenate([[0], np.cumsum(lengths)])
    inner = np.arange(before[-1]) - np.repeat(before[:-1], lengths)
    points, offsets, part = t.points[np.repeat(starts, lengths) + inner], before[offsets], np.repeat(part, lengths)
    row, role = row_of(offsets), t.role[points]
    word = _segments((role & (LETTER | DIGIT | MARK)) > 0, row)
    looks, mixed, latin = (role & LOOKS) > 0, (role & MIXED) > 0, (role & LATIN) > 0
    other = ((role & LETTER) > 0) & ~looks & ~latin
    with_latin = _any_in(word, latin)
    swap = (looks & (with_latin | ~_any_in(word, other))) | (mixed & with_latin)
    kana = _segments((role & (KANA | KANA_LIKE)) > 0, row)
    like = (role & KANA_LIKE) > 0
    han = (role & HAN) > 0
    touches = _any_in(kana, (_beside(han, row, -1) | _beside(han, row, 1)) & (kana > 0))
    swap |= like & touches & ~_any_in(kana, (kana > 0) & ~like)
    flagged |= np.bincount(row[swap], minlength=rows) > 0
    points = np.where(swap, t.plain[points], points)
    points, offsets = _compose(points, offsets, t)
    return points, offsets, flagged


def unify_column(column: pa.Array | pa.ChunkedArray) -> tuple[pa.Array, np.ndarray]:
    """The one form of a string column and the mask of changed-by-disguise rows; null stays null and is never flagged."""
    points, offsets, nulls = to_codepoints(column)
    points, offsets, flagged = unify(points, offsets)
    return from_codepoints(points, offsets, nulls), flagged & ~nulls


def with_plain_form(df: DataFrame, column: str, out: str = "plain_form", flag: str = "disguised") -> DataFrame:
    """`df` with the one form of `column` and whether it held a disguised sign.

    Null gives null and false, empty text empty text and false. Rows are not moved: no shuffle.
    Columns of `df` named as `out` or `flag` are replaced."""
    rest = df.drop(out, flag)
    schema = T.StructType([*rest.schema.fields, T.StructField(out, T.StringType()), T.StructField(flag, T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text, flagged = unify_column(batch.column(batch.schema.get_field_index(column)))
            yield pa.RecordBatch.from_arrays([*batch.columns, text, pa.array(flagged)], names=[*batch.schema.names, out, flag])

    return rest.mapInArrow(run, schema)
