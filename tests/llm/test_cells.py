"""Words, hashes and windows on Arrow buffers against plain Python."""

import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings, strategies as st

from clickloom.llm import cells
from clickloom.llm.cells import ALNUM, LOWER_CODES, SPACE, Texts, owner, repeated, slices, windows

TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet="aAbé \n\t.中", max_size=30)), max_size=6)


@settings(max_examples=200, deadline=None)
@given(TEXTS)
def test_words_and_hashes(texts):
    t = Texts(pa.array(texts, pa.string()))
    start, end, ptr = t.runs(~SPACE)
    got = [[bytes(t.raw[s:e]).decode() for s, e in zip(start[a:b], end[a:b])] for a, b in zip(ptr[:-1], ptr[1:])]
    assert got == [re.findall(r"[^\x20\x09-\x0D]+", x or "") for x in texts]
    flat = [w for g in got for w in g]
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for codes, key in ((None, str), (LOWER_CODES, lambda w: w.translate(low))):
        h = t.hashes(start, end) if codes is None else t.hashes(start, end, codes)
        for i, a in enumerate(flat):
            for j, b in enumerate(flat):
                assert (h[i] == h[j]) == (key(a) == key(b))


@settings(max_examples=100, deadline=None)
@given(TEXTS)
def test_windows_and_repeats(texts):
    t = Texts(pa.array(texts, pa.string()))
    start, end, ptr = t.runs(~SPACE)
    h, doc = t.hashes(start, end), owner(ptr)
    grams, first = windows(h, ptr, 2)
    words = [re.findall(r"[^\x20\x09-\x0D]+", x or "") for x in texts]
    assert len(grams) == sum(max(0, len(w) - 1) for w in words)
    again, later = repeated(h, doc)
    flat = [(d, w) for d, ws in enumerate(words) for w in ws]
    assert again.tolist() == [flat.count(x) > 1 for x in flat]
    assert later.tolist() == [x in flat[:i] for i, x in enumerate(flat)]
    assert all(doc[f] == doc[f + 1] for f in first)


def test_sliced_arrays_nulls_and_large_types():
    whole = pa.array(["xx", "ab c", None, "", "dé"], pa.string())
    for column in (whole.slice(1), pa.array(["ab c", None, "", "dé"], pa.large_string())):
        t = Texts(column)
        assert [bytes(t.raw[a:b]).decode() for a, b in zip(t.offs[:-1], t.offs[1:])] == ["ab c", "", "", "dé"]
        assert t.count(ALNUM).tolist() == [3, 0, 0, 3]
    assert Texts(pa.array([], pa.string())).n == 0
    assert Texts(pa.array([None, None], pa.string())).offs.tolist() == [0, 0, 0]


def test_slices_keep_every_row():
    batch = pa.RecordBatch.from_arrays([pa.array(["a" * 10, None, "b" * 100, "", "c"]), pa.array(np.arange(5))], names=["text", "i"])
    parts = list(slices(batch, "text", 12))
    assert [i for p in parts for i in p.column("i").to_pylist()] == [0, 1, 2, 3, 4]
    assert all(sum(len(x or "") for x in p.column("text").to_pylist()) <= 12 or p.num_rows == 1 for p in parts)


def test_large_tables_go_with_another_task(monkeypatch):
    from clickloom.llm import cells

    monkeypatch.setattr(cells, "_task", lambda: now)
    batch = pa.record_batch({"text": pa.array(["a"])})
    now = 1
    cells.task_state("test").made = "table"
    list(cells.slices(batch, "text"))
    assert cells.task_state("test").made == "table"  # the same task, or one that asks for it again
    now = 2
    list(cells.slices(batch, "text"))
    assert not hasattr(cells.task_state("test"), "made")


def test_tables_for_long_texts_go_with_their_task(monkeypatch):
    """Powers for a long text are not kept by the worker when its next task begins, and are right when cut and grown again."""
    was = cells.worker_state("powers").__dict__.copy()
    for task, n in ((1, 3 << 20), (2, 10), (3, (1 << 20) + 7)):
        monkeypatch.setattr(cells, "_task", lambda: task)
        list(slices(pa.RecordBatch.from_pydict({"t": ["a"]}), "t"))
        kept = cells.worker_state("powers")
        assert task == 1 or len(kept.up) == len(kept.down) == 1 << 20
        up, down = cells.powers(n)
        assert len(up) == len(down) == n and (up * down == 1).all() and (up[1:] == up[:-1] * up[1]).all()
    cells.worker_state("powers").__dict__.update(was)
