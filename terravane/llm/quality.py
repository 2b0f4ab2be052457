"""Per-document text quality statistics and fixed-threshold rules with a reason for each failure.

All counting is done on flattened Arrow arrays: a batch of texts becomes one array of lines, one of passages and one of
tokens, and sums go back to passages and documents by their offsets; nothing is done text by text. The rules are those
published for large corpora (word count, word length, symbols, bullets, ellipses, letters, stop words: Rae et al. 2021;
sentences in lines that end: Raffel et al. 2020; line ends, short and repeated lines: Penedo et al. 2024).

``prose_share`` says how much of a text stands in passages of prose. A passage is a line, a cell or a block of markup, with wrapped
lines put together. It is judged by structure, in any language: it consists of words; words have the shape of words (vowels
for their script, no long runs of consonants, no endless length); it is no enumeration (words per comma) and no
repetition (distinct words); it has the mix of short and long words, or the sentence ends, of running text. Common words
are one more sign, never needed. Scripts without blanks between words are judged by letters and sentence marks. Markup
and quote marks are not counted against a passage, but a text that is mostly markup is no prose.

A text is ``no_prose`` if it fails a published rule and less than half of it is prose; the share is the check behind the rules.

Defined cases: NULL, empty and blank texts have counts of 0, ratios of NULL and the reason ``empty``; texts of fewer than 40
characters without surrounding blanks are never ``no_prose``; common_words may be empty, hold NULLs or repeats.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MIN_CHARS, MIN_PROSE, MAX_MARKUP = 40, 0.5, 0.75
MAX_COMMON = 200_000
#: A passage is prose: letters in words per character, well-shaped words, words per comma, words of running text without an end, words per sentence.
LETTERS, SHAPED, PER_COMMA, OPEN_WORDS, SENTENCE = 0.5, 0.7, 3.0, 6, (2.0, 80.0)
#: Share of words of at most three letters, or of common words, in running text; share of longer words; distinct words.
SHORT, COMMON, LONGER, DISTINCT = 0.12, 0.12, 0.12, 6
#: Least share of vowels among the letters of a script; letters drawn at random stay below.
VOWELS = {"latin": ("a-z", "aeiouy", 0.29), "cyrillic": (r"\p{Cyrillic}", "аеёиоуыэюяіїє", 0.34), "greek": (r"\p{Greek}", "αεηιουω", 0.38)}

STATS = (
    "n_chars long, n_words long, mean_word_length double, symbol_ratio double, digit_ratio double, n_lines long, n_sentences long, punctuated_lines double, bullet_lines double, "
    "ellipsis_lines double, short_lines double, repeated_lines double, alphabetic_words double, common_words long, common_ratio double, prose_share double, reasons array<string>"
)

_BREAK = r"\r\n|[\r\n\x{2028}\x{0085}]"
_BLOCK = r"(?i)</?(?:li|ul|ol|p|br|div|tr|td|th|table|blockquote|h\d|pre|hr)(?:\s[^<>]{0,300})?/?>"
_PASSAGE = r"\r\n|[\r\n\x{2028}\x{0085}\t|]| {4,}"
_UNSPACED = r"[\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}]"
_MARKUP = r"<[^<>]{0,300}>|\[/?[A-Za-z]{2,}(?:=[^\]]{0,200})?\]|\[/?[biu]\]|&(?:[A-Za-z]+|#\d+);|\{\{[^{}]*\}\}"
_INVISIBLE = r"[\x{200B}-\x{200F}\x{2060}-\x{2064}\x{FEFF}\x{00AD}]"
_SPLIT = r"[\s\x{00A0}\x{3000}，。、；：！？]+"
_TRIM = ".,;:!?…\"'()[]{}“”«»„‚‘’*_~-–—>¿¡،؟؛。，|"
_WORD = r"^[\p{L}\p{M}]+(?:['’\x{2010}-][\p{L}\p{M}]+)*$"
_DENSE = r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}]"
_BULLET = r"^\s*(?:[-*+•–—+◦▪‣·]|\(?\d{1,4}[.)]|\(?[A-Za-z][.)]|#\d+|\[[ xX]?\])\s+"
_CLOSE = r"[\"'”’»)\]*_]*"
_ENDS = rf"[.!?…。！？؟।]{_CLOSE}\s*$"
_RUN = "[bcdfghjklmnpqrstvwxz]{6}"


def _per(parent: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(parent, weights=values, minlength=n)


def _ratio(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.divide(a, b, out=np.full(len(a), np.nan), where=b > 0)


def _np(a) -> np.ndarray:
    return pc.cast(a, pa.float64()).to_numpy(zero_copy_only=False)


def _hits(a: pa.Array, pattern: str) -> np.ndarray:
    return _np(pc.match_substring_regex(a, pattern))


def _count(a: pa.Array, pattern: str) -> np.ndarray:
    return _np(pc.count_substring_regex(a, pattern))


def _distinct(owner: np.ndarray, items: pa.Array, n: int) -> np.ndarray:
    """Number of distinct items of each owner."""
    return _distinct_codes(owner, items.dictionary_encode().indices.to_numpy(), n)


def _distinct_codes(owner: np.ndarray, codes: np.ndarray, n: int) -> np.ndarray:
    width = int(codes.max()) + 1 if len(codes) else 1
    pairs = np.sort(owner.astype(np.int64) * width + codes)
    return np.bincount(pairs[np.append(True, pairs[1:] != pairs[:-1])[: len(pairs)]] // width, minlength=n)[:n].astype(float)


class Tokens:
    """Features of tokens, found once for each distinct token of the batch."""

    def __init__(self, tokens: pa.Array, common: pa.Array) -> None:
        coded = tokens.dictionary_encode()
        self.code, once = coded.indices.to_numpy(), coded.dictionary
        core = pc.utf8_lower(pc.utf8_trim(once, characters=_TRIM))
        self.name = core.dictionary_encode().indices.to_numpy()
        self.size, self.word, self.common = _np(pc.utf8_length(core)), _hits(core, _WORD), _np(pc.is_in(core, value_set=common))
        self.letters = _hits(core, r"\p{L}")
        self.ends = _hits(once, rf"[\p{{L}}\p{{M}}\p{{Nd}}%]{_CLOSE}[.!?…؟।]+{_CLOSE}$")
        self.unspaced = _hits(once, _UNSPACED)
        plain = pc.replace_substring_regex(pc.utf8_normalize(core, "NFD"), r"\p{M}+", "")
        self.spelled = np.maximum(self.size, _np(pc.utf8_length(plain)))  # a Hangul syllable counts by its letters
        self.bad = self.word * ((self.size > 24) | (_hits(plain, _RUN) > 0))
        self.script = {}
        for script, (letters, vowels, _) in VOWELS.items():
            of, sung = self.word * _count(plain, f"[{letters}]"), self.word * _count(plain, f"[{vowels}]")
            self.bad = np.maximum(self.bad, (of >= 4) & (sung == 0))
            self.script[script] = of, sung

    def of(self, feature: np.ndarray) -> np.ndarray:
        return feature[self.code]


def passages(text: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """Lines, cells and blocks of each text without markup and bullets; the text they are of, which had bullets, which only name whom the next one quotes."""
    split = pc.split_pattern_regex(pc.replace_substring_regex(text, _BLOCK, "\n"), _PASSAGE)
    block, owner = pc.list_flatten(split), pc.list_parent_indices(split).to_numpy()
    quoted = _hits(block, r"^\s*>") > 0
    bare = pc.replace_substring_regex(pc.replace_substring_regex(pc.replace_substring_regex(block, r"^[\s>]+", ""), _INVISIBLE, ""), _MARKUP, " ")
    names = (_hits(bare, r":\s*$") > 0) & np.append(quoted[1:] & (owner[1:] == owner[:-1]), False)
    return pc.replace_substring_regex(bare, _BULLET, ""), owner, _hits(bare, _BULLET) > 0, names


def measure(texts: pa.Array, common: pa.Array) -> dict[str, np.ndarray]:
    """Statistics of a batch of texts; common: distinct lower-case words."""
    n = len(texts)
    text = pc.utf8_trim_whitespace(pc.fill_null(texts.cast(pa.large_string()), ""))
    split = pc.split_pattern_regex(text, _BREAK)
    doc, line = pc.list_parent_indices(split).to_numpy(), pc.list_flatten(split)
    kept = pc.replace_substring_regex(line, r"^[\s>]+", "")
    l_chars = _np(pc.utf8_length(pc.replace_substring_regex(line, r"\s+", "")))
    real = (l_chars > 0).astype(float)
    chars = _per(doc, l_chars, n)
    out: dict[str, np.ndarray] = {"n_chars": _np(pc.utf8_length(text)), "n_lines": _per(doc, real, n)}
    out["digit_ratio"] = _ratio(_count(text, r"\p{Nd}"), chars)
    for name, pattern in (("punctuated_lines", _ENDS), ("bullet_lines", _BULLET), ("ellipsis_lines", r"(?:\.\.\.|…)\s*$")):
        out[name] = _ratio(_per(doc, _hits(kept, pattern) * real, n), out["n_lines"])
    out["short_lines"] = _ratio(_per(doc, (_np(pc.utf8_length(kept)) < 30) * real, n), out["n_lines"])
    full_lines = np.flatnonzero(real)
    out["repeated_lines"] = 1 - _ratio(_distinct(doc[full_lines], line.take(pa.array(full_lines)), n), out["n_lines"])

    whole = (_hits(kept, _ENDS) > 0) & (_count(kept, r"\S+") >= 5)
    out["n_sentences"] = _per(doc, whole * _count(kept, rf"[.!?…。！？؟।]+{_CLOSE}(?:\s|$)"), n)

    bare, owner, bullet, names = passages(text)
    words = pc.split_pattern_regex(bare, _SPLIT)
    at, token = pc.list_parent_indices(words).to_numpy(), pc.list_flatten(words)
    filled = pc.greater(pc.utf8_length(token), 0)
    token, at = pc.filter(token, filled), at[filled.to_numpy(zero_copy_only=False)]
    known, tok = Tokens(token, common), owner[at]
    out["n_words"] = _per(tok, np.ones(len(at)), n)
    out["mean_word_length"] = _ratio(_per(tok, known.of(known.size), n), out["n_words"])
    out["symbol_ratio"] = _ratio(_count(text, r"#|\.\.\.|…"), out["n_words"])
    out["alphabetic_words"] = _ratio(_per(tok, known.of(known.letters), n), out["n_words"])
    out["common_words"] = _per(tok, known.of(known.common), n)
    out["common_ratio"] = _ratio(out["common_words"], out["n_words"])
    prose, weight = _prose(bare, owner, bullet, at, known)
    weight = weight * ~names
    share = _ratio(_per(owner, prose * weight, n), _per(owner, weight, n))
    bare_chars = _per(owner, weight, n)
    with np.errstate(invalid="ignore"):
        out["prose_share"] = np.where((chars > 0) & (bare_chars < (1 - MAX_MARKUP) * chars) & ~(share >= 1), 0.0, share)
    return out


def _prose(bare: pa.Array, owner: np.ndarray, bullet: np.ndarray, at: np.ndarray, known: Tokens) -> tuple[np.ndarray, np.ndarray]:
    """Which passages are prose, and their characters. at: passage of each token."""
    rows = len(bare)
    weight = _np(pc.utf8_length(pc.replace_substring_regex(bare, r"[\s\x{00A0}]+", "")))
    ended, is_word = _hits(bare, _ENDS) > 0, known.of(known.word)
    n_words = _per(at, is_word, rows)
    # a line that goes on in lower case belongs to the passage before it
    begins = pc.match_substring_regex(bare, r"^\s*[\p{Ll}\p{Lo}]").to_numpy(zero_copy_only=False)
    joins = np.zeros(rows, bool)
    joins[1:] = (owner[1:] == owner[:-1]) & begins[1:] & ~bullet[1:] & ~bullet[:-1] & ~ended[:-1] & (n_words[:-1] >= 4)
    unit = np.cumsum(~joins) - 1
    units = int(unit[-1]) + 1 if rows else 0
    up = unit[at]

    def total(feature: np.ndarray) -> np.ndarray:
        return _per(up, known.of(feature), units)

    chars, words = _per(unit, weight, units), _per(unit, n_words, units)
    marked, final = _per(unit, bullet, units) > 0, np.zeros(units, bool)
    final[unit[ended]] = True
    letters, bad = total(known.word * known.size), total(known.bad)
    voiced = np.ones(units, bool)
    for script, (_, _, least) in VOWELS.items():
        of, sung = (total(f) for f in known.script[script])
        voiced &= sung >= least * of - np.sqrt(of * least * (1 - least))
    ends = np.maximum(total(known.ends), final)
    commas = _per(unit, _count(bare, r"[,;،؛、，；]"), units)
    short, longer = total(known.word * (known.spelled <= 3)), total(known.word * (known.spelled >= 4))
    usual = total(known.common)
    many = np.flatnonzero(is_word)
    distinct = _distinct_codes(up[many], known.name[known.code[many]], units)
    per_end = np.divide(words, ends, out=np.zeros(units), where=ends > 0)
    closed = (ends > 0) & (per_end >= SENTENCE[0]) & (per_end <= SENTENCE[1]) & (words >= 2)
    running = (words >= OPEN_WORDS) & ((short >= SHORT * words) | (usual >= COMMON * words)) & (~marked | (words >= 2 * OPEN_WORDS))
    good = (letters >= LETTERS * chars) & (bad <= (1 - SHAPED) * words) & voiced
    good &= words >= PER_COMMA * (commas + 1) * (words >= OPEN_WORDS)
    good &= distinct >= np.minimum(DISTINCT, words / 2)
    good &= (longer >= LONGER * words) | (words < 10)
    prose = good & (closed | running) & (words > 0)
    # scripts without blanks: letters and sentence marks
    dense = _per(unit, _count(bare, _DENSE), units)
    clauses = _per(unit, _count(bare, r"[。！？，、；.!?,]"), units)
    kinds = _per(unit, _np(pc.greater(pc.utf8_length(bare), 0)), units)
    flowing = (dense >= LETTERS * chars) & (dense >= 6 * kinds) & (clauses > 0) & (dense <= 60 * clauses) & (dense >= 3 * clauses) & (ends + _per(unit, _count(bare, r"[。！？]"), units) > 0)
    phrases = total(known.unspaced)
    flowing |= (_per(unit, _count(bare, _UNSPACED), units) >= np.maximum(LETTERS * chars, 8 * phrases)) & (phrases > 0)
    prose = np.where(dense > 0.3 * np.maximum(letters, 1), flowing, prose)
    return prose[unit].astype(float) if rows else np.zeros(0), weight


def rules(m: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Which rule each text fails; ``no_prose`` needs one of the published rules and the share of prose."""
    with np.errstate(invalid="ignore"):
        empty = m["n_chars"] == 0
        failed = {
            "empty": empty,
            "too_few_words": ~empty & (m["n_words"] < 50),
            "too_many_words": m["n_words"] > 100_000,
            "word_length": (m["mean_word_length"] < 3) | (m["mean_word_length"] > 10),
            "symbols": m["symbol_ratio"] > 0.1,
            "bullets": m["bullet_lines"] > 0.9,
            "ellipses": m["ellipsis_lines"] > 0.3,
            "few_letters": m["alphabetic_words"] < 0.8,
            "no_common_words": ~empty & (m["common_words"] < 2),
            "line_ends": m["punctuated_lines"] <= 0.12,
            "few_sentences": ~empty & (m["n_sentences"] < 3),
            "short_lines": m["short_lines"] >= 0.67,
            "repeated_lines": m["repeated_lines"] > 0.3,
        }
        any_failed = np.logical_or.reduce(list(failed.values()))
        low = ~(m["prose_share"] >= MIN_PROSE)
        return failed | {"no_prose": any_failed & (m["n_chars"] >= MIN_CHARS) & low}


def assess(docs: DataFrame, common_words: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, the statistics and ``reasons``, one row per document; a map over the partitions, no shuffle.

    The word list is sent to all tasks; it must hold at most MAX_COMMON words.
    """
    listed = common_words.select(F.lower("word").alias("w")).where("w is not null").distinct().limit(MAX_COMMON + 1).collect()
    if len(listed) > MAX_COMMON:
        raise ValueError("the list of common words is too long to send to every task")
    known = sorted(r["w"] for r in listed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common = pa.array(known, pa.large_string())
        for b in batches:
            if not b.num_rows:
                continue
            m = measure(b["text"], common)
            failed = rules(m)
            names = np.array(list(failed), dtype=object)
            grid = np.stack(list(failed.values()), axis=1)
            counts = grid.sum(axis=1)
            reasons = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)), pa.int32()), pa.array(names[np.nonzero(grid)[1]], pa.string()))
            cols = [pa.array(m[f.split()[0]], pa.int64()) if f.endswith("long") else pa.array(m[f.split()[0]], pa.float64(), from_pandas=True) for f in STATS.split(", ")[:-1]]
            yield pa.RecordBatch.from_arrays([b["key"], *cols, reasons], ["key", *[f.split()[0] for f in STATS.split(", ")]])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"key {kind}, {STATS}").withColumnRenamed("key", key)
