"""Quality rules, line first: rules judge every line, failing lines go, and a document that
loses too much of its text goes as a whole.

The work is one narrow pass (``mapInArrow``) without shuffle or state, vectorised over the
bytes of many documents, so a lost executor costs the repetition of its own tasks only.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import col, fresh, map_arrow, schema_of
from ._text import Chunk, chunks, mix, shingles

#: The characters that count as symbols.
SYMBOLS = "[#*$%&|<>]"

#: Phrases of licence, consent and legal lines, in lower case.
BOILERPLATE = (
    "all rights reserved", "licensed under", "is licensed under", "released under the", "accept cookies", "cookie policy",
    "privacy policy", "terms of service", "terms of use", "subscribe to our newsletter", "javascript is disabled", "lorem ipsum",
)


@dataclass(frozen=True)
class Rules:
    """Limits of the rules. Shares are of a line's words, or for ``max_lost`` of the characters
    in words of all lines that are no boilerplate: a licence line goes, but does not speak
    against the rest of its document."""

    min_words: int = 10
    max_repeat: float = 0.20
    max_lost: float = 0.50
    max_bars: float = 0.15
    max_symbols: float = 0.5
    max_capitals: float = 0.8
    min_distinct: float = 0.35
    from_words: int = 8
    boilerplate: tuple[str, ...] = field(default=BOILERPLATE)


_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[[ord(c) for c in SYMBOLS[1:-1]]] = True
_UPPER = np.zeros(256, dtype=bool)
_UPPER[65:91] = True
_LETTER = _UPPER.copy()
_LETTER[97:123] = True
#: Characters that may end a sentence, closing marks included.
STOPS = ".!?:;)]\"'\u2026\u201d\u2019\u201c\u00bb\u203a\u3002\uff01\uff1f\uff1a\uff1b\uff0e\uff61\u300d\u300f\uff09\u061f\u06d4\u061b\u0964\u0965\u0589\u1362\u17d4\u104b"
#: Their UTF-8 bytes as numbers.
_STOP = np.array(sorted(int.from_bytes(c.encode(), "big") for c in STOPS))
_SALT = np.uint64(0x9E3779B97F4A7C15)


def _per(total: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Sums between consecutive places of a running total that starts with 0."""
    return np.diff(total[begins])


def _running(x: np.ndarray) -> np.ndarray:
    out = np.zeros(len(x) + 1, dtype=np.int64)
    np.cumsum(x, out=out[1:])
    return out


def _distinct(keys: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Distinct keys in each stretch."""
    owner = np.repeat(np.arange(len(begins) - 1), np.diff(begins))
    _, first = np.unique(mix(keys ^ (owner.astype(np.uint64) * _SALT)), return_index=True)
    return np.bincount(owner[first], minlength=len(begins) - 1)


def _stops(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Whether the last code point before each end may end a sentence. Those of four bytes never do."""
    code = data[ends - 1].astype(np.int64)
    back = np.zeros(len(ends), dtype=np.int64)
    for k in (1, 2):  # a code point goes on to the left as long as its byte is no first one
        more = (back == k - 1) & ((data[ends - k] & 0xC0) == 0x80) & (ends - k > 0)
        code[more] |= data[ends[more] - k - 1].astype(np.int64) << (8 * k)
        back[more] = k
    return np.isin(code, _STOP)


def judge(c: Chunk, rules: Rules) -> tuple[dict[str, np.ndarray], np.ndarray, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Figures of each document, which lines fail, and the lines."""
    starts, ends, begins = c.words()
    points = c.code_points()
    n_words = np.diff(begins)
    size = points[ends] - points[starts]
    sizes = _running(size)
    symbols = _running(_SYMBOL[c.data])
    raw = c.span_hash(starts, ends, raw=True)

    lines = line_starts, line_ends, line_begins = c.lines()
    first_word, last_word = np.searchsorted(starts, line_starts), np.searchsorted(starts, line_ends)
    n_line = last_word - first_word
    full = n_line > 0
    doc_of_line = np.repeat(np.arange(c.n), np.diff(line_begins))
    hashes = c.span_hash(line_starts[full], line_ends[full], raw=True)
    owner = doc_of_line[full]
    _, first = np.unique(mix(hashes ^ (owner.astype(np.uint64) * _SALT)), return_index=True)
    dup_lines = np.bincount(owner, minlength=c.n) - np.bincount(owner[first], minlength=c.n)

    windows, window_begins = shingles(raw, begins)
    window_doc = np.repeat(np.arange(c.n), np.diff(window_begins))
    _, inverse, count = np.unique(mix(windows ^ (window_doc.astype(np.uint64) * _SALT)), return_inverse=True, return_counts=True)
    again = np.flatnonzero(count[inverse] > 1)
    first_of_window = again - window_begins[window_doc[again]] + begins[window_doc[again]]
    step = np.zeros(len(starts) + 6, dtype=np.int64)
    np.add.at(step, first_of_window, 1)
    np.add.at(step, first_of_window + 5, -1)
    repeated = _running(np.cumsum(step[: len(starts)]) > 0)
    n_repeat = _per(repeated, begins)

    ok = np.maximum(n_line, 1)
    bar = _running((ends - starts == 1) & (c.data[starts] == 124)) if len(starts) else np.zeros(1, np.int64)
    upper, letters = _running(_UPPER[c.data]), _running(_LETTER[c.data])
    n_letters = letters[line_ends] - letters[line_starts]
    long_line = n_line >= rules.from_words
    stops = _running(_stops(c.data, ends)) if len(ends) else np.zeros(1, np.int64)
    line_words = np.concatenate([[0], np.cumsum(n_line)])
    # distinct words of ordinary prose grow about as the square root of its length
    least_distinct = rules.min_distinct * np.sqrt(rules.from_words * ok)
    fails = full & (
        (stops[last_word] == stops[first_word])
        | ((bar[last_word] - bar[first_word]) / ok > rules.max_bars)
        | ((symbols[line_ends] - symbols[line_starts]) / ok > rules.max_symbols)
        | (long_line & ((upper[line_ends] - upper[line_starts]) > rules.max_capitals * np.maximum(n_letters, 1)))
        | (long_line & (_distinct(raw, line_words) < least_distinct))
    )
    lower = c.data.copy()
    lower[_UPPER[lower]] += 32
    text = lower.tobytes()
    legal = np.zeros_like(fails)
    for phrase in rules.boilerplate:
        p, at = phrase.encode(), text.find(phrase.encode())
        while at >= 0:
            i = int(np.searchsorted(line_starts, at, side="right")) - 1
            if at + len(p) <= line_ends[i]:
                legal[i] = True
            at = text.find(p, at + 1)

    chars = _per(sizes, begins)
    line_chars = sizes[last_word] - sizes[first_word]
    lost = np.bincount(doc_of_line, weights=line_chars * (fails & ~legal), minlength=c.n)
    own = chars - np.bincount(doc_of_line, weights=line_chars * legal, minlength=c.n)
    fails |= legal
    failed = (n_words < rules.min_words) | (n_repeat > rules.max_repeat * n_words + 1e-9)
    out = {
        "n_words": n_words, "word_chars": chars, "n_symbols": _per(symbols, c.offsets), "n_dup_lines": dup_lines, "n_repeat_words": n_repeat,
        "base_failed": failed, "kept": ~failed & (own > 0) & (lost <= rules.max_lost * own), "lost_chars": lost.astype(np.int64),
    }
    return out, fails, lines


def apply_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: Rules | None = None, with_text: bool = False) -> DataFrame:
    """A row for each document: ``id_col`` and the longs n_words, word_chars, n_symbols,
    n_dup_lines, n_repeat_words, lost_chars, the booleans base_failed and kept, and with
    ``with_text`` the text of the lines that stay.

    Null and empty texts have figures of 0, fail the base and are not kept; null ids pass
    through; repeated rows are judged one by one; an empty table gives an empty result.
    Columns besides the two named ones are not read. Where ``id_col`` is one of the new names, an
    underscore is put before the new one.
    """
    rules = rules or Rules()
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "lost_chars"]
    ids = docs.select(col(id_col).alias(id_col))
    called = fresh(ids, *names, "base_failed", "kept", *["text"] * with_text)
    kinds = ["long"] * len(names) + ["boolean"] * 2 + ["string"] * with_text
    schema = schema_of(ids.schema, ", ".join(f"{n} {k}" for n, k in zip(called, kinds, strict=True)))

    def run(batches):
        for b in batches:
            for c in chunks(b.column(1)):
                got, fails, (starts, ends, begins) = judge(c, rules)
                cols = [b.column(0).slice(c.first, c.n)] + [pa.array(got[n].astype(np.int64)) for n in names] + [pa.array(got[n]) for n in ("base_failed", "kept")]
                if with_text:
                    whole, texts = c.data.tobytes(), []
                    for d in range(c.n):
                        keep = np.flatnonzero(~fails[begins[d] : begins[d + 1]]) + begins[d]
                        texts.append(b"\n".join(whole[starts[i] : ends[i]] for i in keep).decode())
                    cols.append(pa.array(texts, pa.string()))
                yield pa.RecordBatch.from_arrays(cols, [id_col, *called])

    return docs.select(col(id_col).alias(id_col), col(text_col).alias(fresh(ids, "read_text")[0])).transform(map_arrow, run, schema)
