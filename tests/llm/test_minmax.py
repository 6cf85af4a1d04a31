import random

import numpy as np
import pyarrow as pa

from strandline.llm import minmax as M

SCHEMA = "row_id bigint, ref_allele string, alt_allele string, rep string, allele string"


def likeness(a: str, b: str, k: int = 12) -> float:
    x, y = ({s[i : i + k] for i in range(len(s) - k + 1)} for s in (a, b))
    return len(x & y) / len(x | y)


def edited(rng: random.Random, text: str, edits: int) -> str:
    out = list(text)
    for _ in range(edits):
        i = rng.randrange(len(out))
        out[i] = rng.choice(["", "A", "CG", "T"])
    cut = rng.randrange(len(out))
    return "".join(out[cut:] + out[:cut]) if rng.random() < 0.3 else "".join(out)


def test_window_codes_agree_with_slices():
    texts = ["ACGTNACGTNACGT", "ACGTACGTACGT", "ACG", "", "TTTTTTTTTTTTT"]
    column = pa.array(texts)
    for k in (1, 3, 5, 12):
        codes, counts = M.window_codes(*M._text_arrays(column), k)
        want = [t[i : i + k] for t in texts for i in range(len(t) - k + 1)]
        value = lambda s: int("".join(str("ACGTN".index(c)) for c in s), 5)
        assert counts.tolist() == [max(0, len(t) - k + 1) for t in texts]
        assert codes.tolist() == [value(s) for s in want]


def test_signature_keeps_minimum_and_maximum_of_each_permutation():
    codes = np.array([5, 900, 77, 12345, 5], np.uint32)
    got = M.minmax_signature(codes, np.array([3, 2]), 4)
    flips, factors = M._permutations(4, M.SEED)
    for band in range(4):
        h = (M._mixed(codes) ^ flips[band]) * factors[band]
        for row, part in ((0, h[:3]), (1, h[3:])):
            assert int(got[row, band]) == (int(part.min()) << 32) | int(part.max())


def test_pairs_equal_brute_force(spark):
    rng = random.Random(4)
    rows, alleles = [], []
    for family in range(25):
        base = "".join(rng.choice("ACGT") for _ in range(rng.randint(160, 400)))
        for _ in range(rng.randint(1, 6)):
            alleles.append(edited(rng, base, rng.choice([0, 0, 2, 5, 9])))
    alleles += ["ACGT" * 50, "ACGT" * 60, "N" * 160, "A" * 149, "A" * 150]
    for i, a in enumerate(alleles):
        ref, alt = ("A", a) if i % 2 else (f"  {a.lower()} ", "c")
        rows.append((i, ref, alt, "clash", "clash"))
    rows += [(1000, None, alleles[0], None, None), (1001, "A", None, None, None), (None, "A", alleles[0], None, None), (1002, "A", "<INS>", None, None), (1003, "", "", None, None)]
    rows.append((1004, "A", "ACGTTGCA" * 60_000, None, None))
    got = sorted(tuple(r) for r in M.near_duplicate_calls(spark.createDataFrame(rows, SCHEMA)).collect())
    long = [(i, a.upper()) for i, a in enumerate(alleles) if len(a) >= 150]
    want = sorted((i, j) for n, (i, a) in enumerate(long) for j, b in long[n + 1 :] if likeness(a, b) >= 0.5)
    assert len(want) > 20
    assert got == want
    root = {i: i for i, _ in long}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in want:
        a, b = sorted((top(i), top(j)))
        root[b] = a
    same = {a: min(i for i, x in long if x == a) for _, a in long}
    near = {a: {b for b in same if b != a and likeness(a, b) >= 0.5} for a in same}
    found = sorted(tuple(r) for r in M.near_duplicate_groups(spark.createDataFrame(rows, SCHEMA)).collect())
    assert found[: len(long)] == [(i, same[a], top(i), len(near[a])) for i, a in long] and found[len(long) :] == [(1004, 1004, 1004, 0)]


def test_hot_text_and_empty_table(spark):
    text = "".join(random.Random(1).choice("ACGT") for _ in range(200))
    got = M.near_duplicate_calls(spark.createDataFrame([(i, "A", text, "", "") for i in range(30)], SCHEMA))
    assert sorted(tuple(r) for r in got.collect()) == [(i, j) for i in range(30) for j in range(i + 1, 30)]
    assert M.near_duplicate_calls(spark.createDataFrame([], SCHEMA)).count() == 0
    assert sorted(tuple(r) for r in M.near_duplicate_groups(spark.createDataFrame([(i, "A", text, "", "") for i in range(30)], SCHEMA)).collect()) == [(i, 0, 0, 0) for i in range(30)]
    assert M.near_duplicate_groups(spark.createDataFrame([], SCHEMA)).count() == 0
