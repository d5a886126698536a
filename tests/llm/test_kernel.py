import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyline.llm import textkernel as tk

LOWER = {i: i + 32 for i in range(65, 91)}
PATTERNS = {"space": r"[^\x20\x09-\x0d]+", "alnum": r"[0-9A-Za-z\x80-\U0010ffff]+"}
TEXT = st.text(alphabet=st.sampled_from(list("aBc é\n\t.0 %")), max_size=12)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.none(), TEXT), max_size=6), st.sampled_from(sorted(PATTERNS)))
def test_words_and_grams(texts, spec):
    data, bounds = tk.texts(pa.array(texts, pa.string()))
    words = tk.Words(data, bounds, tk.byte_class(spec))
    want = [re.findall(PATTERNS[spec], (t or "").translate(LOWER)) for t in texts]
    got = [[bytes(data[s:e]).decode().translate(LOWER) for s, e in zip(words.start[a:b], words.end[a:b], strict=True)] for a, b in zip(words.first[:-1], words.first[1:], strict=True)]
    assert got == want
    flat = [w for ws in want for w in ws]
    assert len(set(words.hash.tolist())) == len(set(flat))
    hashes, at = words.grams(2)
    pairs = [(ws[i], ws[i + 1]) for ws in want for i in range(len(ws) - 1)]
    assert len(at) == len(pairs) and len(set(hashes.tolist())) == len(set(pairs))


def test_chunks_cover_rows(monkeypatch):
    monkeypatch.setattr(tk, "CHUNK_BYTES", 10)
    batch = pa.RecordBatch.from_pydict({"text": ["abc", None, "x" * 50, "", "de", "fgh"]})
    seen = [(a, b, bytes(d).decode()) for a, b, d, _ in tk.chunks(batch)]
    assert [x for a, b, _ in seen for x in range(a, b)] == list(range(6))
    assert "".join(d for *_, d in seen) == "abc" + "x" * 50 + "defgh"


def test_slices_are_read_from_their_start():
    column = pa.array(["zz", "a b", "c"])[1:]
    words = tk.Words(*tk.texts(column), tk.byte_class("space"))
    assert np.diff(words.first).tolist() == [2, 1]
