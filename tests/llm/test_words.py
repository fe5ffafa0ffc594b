import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from scoreline.llm import words as wd

TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet=" \t\n\x0baAbB1.é😀", max_size=30)),
                 min_size=1, max_size=6)


def batch(texts):
    return pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], names=["text"])


@settings(max_examples=200, deadline=None)
@given(TEXTS, st.integers(1, 40))
def test_words_equal_regular_expression(texts, size):
    got = []
    for part, buf, offs in wd.blocks(batch(texts), max_bytes=size):
        w = wd.Words(buf, offs, segment=3)
        raw = buf.tobytes()
        for d in range(part.num_rows):
            got.append([raw[w.starts[i]:w.ends[i]].decode()
                        for i in range(w.first[d], w.first[d + 1])])
            one = [wd.word_hash(x)[0] for x in got[-1]]
            assert one == w.hash[w.first[d]:w.first[d + 1]].tolist()
    assert got == [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]


def test_ngrams_stay_inside_documents():
    (part, buf, offs), = wd.blocks(batch(["a b c", "d", "a b c d"]))
    w = wd.Words(buf, offs)
    h, doc, pos = wd.ngrams(w.hash, w.counts, 3)
    assert doc.tolist() == [0, 2, 2] and pos.tolist() == [0, 4, 5]
    assert h[0] == h[1] != h[2]


def test_ragged():
    assert wd.ragged(np.array([5, 0, 9]), np.array([2, 0, 3])).tolist() == [5, 6, 9, 10, 11]
    assert len(wd.ragged(np.array([1]), np.array([0]))) == 0
