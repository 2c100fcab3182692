"""Statistics of whole documents: rule counts and ratios, from bytes and words.

Words are ``[^\\x20\\x09-\\x0D]+``, case kept.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from tidepool.llm.common import array_slices, split_words

# The integer counts, then the ratios, in the order of the columns.
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
RATIOS = ("log_words", "chars_per_word", "symbols_per_word", "dup_line_share",
          "repeat_word_share", "distinct_word_share", "upper_share", "digit_share",
          "stop_per_word", "bang_per_word", "pipe_per_word", "other_punct_per_word",
          "non_ascii_share", "words_per_line", "top_word_share", "byte_entropy",
          "longest_word_log")

_SPACE = [32, 9, 10, 11, 12, 13]
# The symbols the rules count.
SYMBOLS = "#*$%&|<>"
_SYMBOL = [ord(c) for c in SYMBOLS]
_STOP = [ord(c) for c in ".,;:?"]
_OTHER = [ord(c) for c in "\"'()[]{}-_/\\@^~`+="]


def _repeat_words(codes: np.ndarray, n_codes: int) -> int:
    """Words inside a 3-word window that occurs at least twice."""
    if len(codes) < 4:
        return 0
    a, b, c = codes[:-2], codes[1:-1], codes[2:]
    if n_codes < 1 << 20:
        key = (a * n_codes + b) * n_codes + c
    else:
        _, pair = np.unique(a * n_codes + b, return_inverse=True)
        key = pair * n_codes + c
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    if not same.any():
        return 0
    twice = np.zeros(len(key), dtype=bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(len(codes), dtype=bool)
    for shift in range(3):
        covered[shift:shift + len(twice)] |= twice
    return int(covered.sum())


def _of_group(texts: list, data: list[bytes], flat: pa.Array, sizes: np.ndarray
              ) -> tuple[np.ndarray, np.ndarray]:
    codes = flat.dictionary_encode()
    indices = codes.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    size = pc.binary_length(codes.dictionary).to_numpy(zero_copy_only=False)
    counts = np.zeros((len(texts), len(COUNTS)), dtype=np.int64)
    ratios = np.zeros((len(texts), len(RATIOS)))
    at = 0
    for i, (text, raw, n) in enumerate(zip(texts, data, sizes.tolist())):
        code = indices[at:at + n]
        at += n
        if not raw:
            continue
        hist = np.bincount(np.frombuffer(raw, dtype=np.uint8), minlength=256)
        spaces = int(hist[_SPACE].sum())
        symbols = int(hist[_SYMBOL].sum())
        lines = [x for x in raw.split(b"\n") if x.strip()]
        dup_lines = len(lines) - len(set(lines))
        repeats = _repeat_words(code, len(codes.dictionary))
        counts[i] = n, len(text) - spaces, symbols, dup_lines, repeats
        if not n:
            continue
        local = np.bincount(np.unique(code, return_inverse=True)[1])
        letters = int(hist[65:91].sum() + hist[97:123].sum()) or 1
        p = hist[hist > 0] / len(raw)
        ratios[i] = (
            np.log1p(n), (len(text) - spaces) / n, symbols / n, dup_lines / len(lines),
            repeats / n, len(local) / n, hist[65:91].sum() / letters,
            hist[48:58].sum() / len(raw), hist[_STOP].sum() / n, hist[33] / n, hist[124] / n,
            hist[_OTHER].sum() / n, hist[128:].sum() / len(raw), n / len(lines),
            local.max() / n, -(p * np.log2(p)).sum(), np.log1p(size[code].max()))
    return counts, ratios


def document_statistics(texts, max_bytes: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """``(counts, ratios)`` of whole texts (an Arrow array or a list), one row
    each in the order of ``COUNTS`` and ``RATIOS``; null and empty texts are
    all zero, texts of white space too but for their counts."""
    texts = texts if isinstance(texts, pa.Array) else pa.array(texts, type=pa.string())
    out = [(np.zeros((0, len(COUNTS)), np.int64), np.zeros((0, len(RATIOS))))]
    for _, part in array_slices(texts, max_bytes):
        group = [t or "" for t in part.to_pylist()]
        out.append(_of_group(group, [t.encode("utf-8", "surrogatepass") for t in group],
                             *split_words(part)))
    return np.concatenate([c for c, _ in out]), np.concatenate([r for _, r in out])
