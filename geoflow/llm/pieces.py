"""Cut texts where a byte-level BPE can be cut, so that each distinct piece is encoded once."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: White space as byte-level pre-tokenizers take it (fixed values).
SPACE = r"\x{09}-\x{0d}\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
#: A space that touches another white space: there the pattern looks further than one character.
UNSAFE = rf" [{SPACE}]|[{SPACE}] "
_CLASS = "".join(f"\\u{x[1:-1].zfill(4)}" if x.startswith("{") else x for x in re.split(r"\\x(\{\w+\})", SPACE))
#: A space between two characters that are not white space: a safe boundary.
SAFE = re.compile(rf"(?<=[^{_CLASS}]) (?=[^{_CLASS}])")


def flat(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Pieces of all texts in a row, and how many each text has.

    A single space between two non-spaces always begins a pre-token, so texts are cut before each of them, and nowhere
    else. Pieces joined give the text again; null is empty.
    """
    texts = pc.fill_null(texts, "")
    odd = pc.match_substring_regex(texts, UNSAFE).to_numpy(zero_copy_only=False)
    # texts whose spaces are all safe, together; a text that ends or begins with a space is cut there too, which changes nothing
    even = texts.filter(pa.array(~odd))
    parts = pc.split_pattern(even, " ")
    n_even = pc.list_value_length(parts).to_numpy(zero_copy_only=False).astype("int64")
    words = parts.flatten()
    lead = np.ones(len(words), bool)
    lead[n_even.cumsum() - n_even] = False
    pieces = pc.binary_join_element_wise(pc.if_else(pa.array(lead, pa.bool_()), " ", ""), words, "")
    if not odd.any():
        return pieces, n_even
    # the others one by one, cut at the safe places that they have
    cut = [SAFE.split(t) for t in texts.filter(pa.array(odd)).to_pylist()]
    more = pa.array([f" {x}" if k else x for t in cut for k, x in enumerate(t)], pieces.type)
    counts, starts = np.zeros(len(texts), "int64"), np.zeros(len(texts), "int64")
    n_odd = np.array([len(t) for t in cut], "int64")
    counts[~odd], counts[odd] = n_even, n_odd
    starts[~odd], starts[odd] = n_even.cumsum() - n_even, len(pieces) + n_odd.cumsum() - n_odd
    at = np.arange(counts.sum()) + np.repeat(starts - (counts.cumsum() - counts), counts)
    return pa.concat_arrays([pieces, more]).take(pa.array(at)), counts
