"""Problems 5 and 7."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ontospan.llm import leaks, split


def check(text, limit, overlap):
    spans = split.cut(text, limit, overlap)
    if not text:
        assert spans == []
        return spans
    assert spans[0][0] == 0 and spans[-1][1] == len(text) and all(0 < e - s <= limit for s, e in spans)
    for (_, before), (start, end) in zip(spans, spans[1:]):
        assert start == max(0, before - overlap) and end > before
    return spans


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab .,\n;!é́😀", max_size=400), st.integers(12, 60), st.integers(0, 11))
def test_pieces_cover_the_text(text, limit, overlap):
    check(text, limit, overlap)


def test_boundaries_come_in_their_order():
    lines = "\n".join("x" * 30 for _ in range(40))
    assert all(lines[e - 1] == "\n" for _, e in check(lines, 100, 10)[:-1])
    sentences = " ".join("aa bb cc dd." for _ in range(40))
    assert all(sentences[e - 2] == "." for _, e in check(sentences, 100, 10)[:-1])
    assert len(check("x" * 1000, 100, 10)) == 12
    assert check("x" * 650, 650, 60) == [(0, 650)] and len(check("x" * 651, 650, 60)) == 2


def test_bad_overlap():
    with pytest.raises(ValueError):
        split.cut("abc", 10, 10)


def test_pieces_table(spark):
    schema = "chunk_id long, doc_id long, start_pos int, text string, piece_no string"
    long = "đau bụng. " * 100
    rows = [(1, 1, 100, long, "clash"), (1, 1, 100, long, "clash"), (2, 1, 0, "ngắn", ""), (3, 1, 0, None, ""), (4, 1, 0, "", ""), (5, None, None, "y" * 2000, "")]
    got = split.pieces(spark.createDataFrame(rows, schema)).orderBy("chunk_id", "piece_no").collect()
    assert {(r.chunk_id, r.n_pieces) for r in got} == {(1, 2), (2, 1), (5, 4)}
    assert all(long[r.start_pos - 100 : r.end_pos - 100] == r.text for r in got if r.chunk_id == 1)
    assert all(r.start_pos is None and r.end_pos is None for r in got if r.chunk_id == 5)
    assert split.pieces(spark.createDataFrame([], schema)).count() == 0


ITEM = " ".join(f"từ{i} chữ{i * 7 % 90}" for i in range(60))  # 120 words
OTHER = " ".join(f"lời{i}" for i in range(60))


def leaked(spark, texts, items):
    docs = spark.createDataFrame([(i, t, 0) for i, t in texts], "doc_id long, text string, item_id int")
    tests = spark.createDataFrame(items, "item_id long, text string")
    return {(r.doc_id, r.item_id): r.words_held for r in leaks.leaks(docs, "doc_id", "text", tests, "item_id", "text").collect()}


def test_cases(spark):
    w = ITEM.split()
    changed = w[:60]
    changed[7], changed[21], changed[40] = "khác", "nữa", "thêm vào"
    shuffled = w[:]
    random.Random(1).shuffle(shuffled)
    texts = [
        (1, "mở đầu " + ITEM.upper() + " kết"), (2, " ".join(w[:45]).replace(" ", ",\n")), (3, " ".join(w[:20])), (4, " ".join(shuffled)), (5, " ".join(changed)),
        (6, " ".join(w[:30]) + " ở giữa là chuyện khác hẳn và dài hơn một chút " + " ".join(w[80:100])), (7, " ".join(w[80:100]) + " ở giữa là chuyện khác hẳn và dài hơn một chút " + " ".join(w[:30])),
        (8, None), (9, ""), (10, "ｔừ0​ " + " ".join(w[1:50])), (11, "chuyện " * 300_000 + ITEM), (12, OTHER),
    ]
    got = leaked(spark, [*texts, (13, "có Hai, tư đây"), (14, "hai người từ đây")], [(1, ITEM), (2, OTHER), (3, None), (4, "hai từ"), (2, OTHER), (5, "?!")])
    assert set(got) == {(1, 1), (2, 1), (5, 1), (6, 1), (10, 1), (11, 1), (12, 2), (13, 4)}  # of an item of two words, both must be there
    assert got[1, 1] == 120 and got[2, 1] == 45 and got[6, 1] == 50


def test_nothing_to_search(spark):
    assert leaked(spark, [(1, ITEM)], []) == {} and leaked(spark, [], [(1, ITEM)]) == {}


@pytest.mark.parametrize("letters,length", [("abcde", 30), ("ab", 12), ("a", 9)])
def test_suffix_array_finds_what_a_scan_finds(letters, length):
    rng = random.Random(9)
    items = [(i, [rng.choice(letters) for _ in range(rng.randint(1, length))]) for i in range(6)]
    texts = [[rng.choice(letters + "z") for _ in range(rng.randint(0, 60))] for _ in range(40)]
    tests, shard = leaks.TestSet(items), leaks.Shard(texts, length)
    got = {(k, i, int(p), int(n)) for k, i, ps, ns in leaks._matches(tests, shard, 4) for p, n in zip(ps, ns)}
    expected, flat = set(), [w for t in texts for w in (*t, None)]
    for k, (_, ws) in enumerate(items):
        for i in range(len(ws)):
            for p in range(len(flat)):
                if i and p and flat[p - 1] == ws[i - 1]:
                    continue
                n = 0
                while i + n < len(ws) and p + n < len(flat) and flat[p + n] == ws[i + n]:
                    n += 1
                if n >= min(4, len(ws)):
                    expected.add((k, i, p, n))
    assert got == expected


def test_chains_by_brute_force():
    """The best of one or two stretches, against all pairs of chains."""
    rng = random.Random(5)
    for _ in range(300):
        runs = sorted({(rng.randint(0, 60), rng.randint(0, 30), rng.randint(4, 8)) for _ in range(rng.randint(1, 9))})
        best = []
        for p, i, n in runs:
            own = (n, p, p + n, i, i + n)
            for w, p0, p1, i0, i1 in best:
                if p0 < p and i0 < i and p + n > p1 and i + n > i1 and -n < p - p1 <= leaks.GAP and -n < i - i1 <= leaks.GAP:
                    own = max(own, (w + n - max(0, p1 - p, i1 - i), p0, p + n, i0, i + n), key=lambda x: x[0])
            best.append(own)
        pairs = [a[0] + b[0] for a in best for b in best if a[2] <= b[1] and a[4] <= b[3]]
        assert leaks.held(runs) == max([*(x[0] for x in best), *pairs])


def test_many_runs_of_one_pair_are_quick():
    import time

    began = time.time()
    assert leaks.held([(50 * k, k % 97, 5) for k in range(20_000)]) == 10 and time.time() - began < 5
