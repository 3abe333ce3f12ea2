"""K-means by kd-trees, alignment of tokenizers, and repeated lines: against brute force, with odd inputs."""

import collections
import hashlib
import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from llm import alignment, kdtree, line_dedup

PUBLIC = pytest.importorskip("public_tokenizers")
A_PATH, B_PATH = PUBLIC.path("byte_bpe_50k.json"), PUBLIC.path("piece_bpe_32k.model")
KIND = "doc_id long, text string, lang string, line string, row long, n long, stretch string"


def documents(spark, rows):
    """Documents with columns whose names clash with those that the operators make."""
    return spark.createDataFrame([(i, t, "en", "x", 7, 9, "s") for i, t in rows], KIND)


def tuples(frame):
    return sorted(map(tuple, frame.collect()), key=str)


# ---- lines ----

def plain_lines(texts, least):
    """(n_lines, n_dropped, kept text) of every text, by a dictionary of all keys."""
    white = " \t\n\x0b\x0c\r"
    small = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    keys = [[line.strip(white).translate(small) for line in (t or "").split("\n")] for t in texts]
    held = collections.Counter(k for own in keys for k in set(own))
    out = []
    for t, own in zip(texts, keys, strict=True):
        lines = (t or "").split("\n")
        stay = [x for x, k in zip(lines, own, strict=True) if not k or held[k] < least]
        out.append((len(lines), len(lines) - len(stay), "\n".join(stay)))
    return out


LINE_TEXTS = [None, "", "\n\n", "A b \nown 1", "a B\nown 2\n", "\ta b\r\nown 3", "a b", "a b", "Ä ä", "ä ä", "x" * 300_000 + "\na b", "own 4\n" * 5, " a b ", "\x85a b"]


@pytest.mark.parametrize("least", [2, 4, 10])
def test_lines_against_a_dictionary(spark, least):
    rows = list(enumerate(LINE_TEXTS)) + [(None, "a b\nz"), (None, "z"), (3, "A b \nown 1")]
    found = line_dedup.drop_repeated_lines(documents(spark, rows), least=least)
    wanted = [(i, *w) for (i, _), w in zip(rows, plain_lines([t for _, t in rows], least), strict=True)]
    assert tuples(found) == sorted(wanted, key=str)


def test_first_occurrence_stays(spark):
    rows = [(5, "a\nx"), (2, "b\nA \na\nb"), (9, "a\nb"), (None, "c"), (1, "c")]
    found = {r["doc_id"]: (r["n_dropped"], r["kept_text"]) for r in line_dedup.drop_repeated_lines(documents(spark, rows), keep_first=True).collect()}
    assert found == {5: (1, "x"), 2: (2, "b\nA "), 9: (2, ""), None: (0, "c"), 1: (1, "")}


def test_lines_of_an_empty_table(spark):
    assert line_dedup.drop_repeated_lines(documents(spark, []), least=10).collect() == []


def test_one_occurrence_is_no_repetition(spark):
    with pytest.raises(ValueError):
        line_dedup.drop_repeated_lines(documents(spark, []), least=1)


def test_many_small_shards_lose_no_line(spark):
    rows = [(i, "\n".join(f"line {(i * 7 + j * j) % 400}" for j in range(20))) for i in range(200)]
    few, many = (tuples(line_dedup.drop_repeated_lines(documents(spark, rows), least=10, shard_lines=n)) for n in (1 << 21, 50))
    assert few == many == sorted(((i, *w) for (i, _), w in zip(rows, plain_lines([t for _, t in rows], 10), strict=True)), key=str)


def test_a_full_filter_changes_nothing(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "FILTER_BITS", 64)
    rows = [(i, f"own {i}\nshared {i % 3}") for i in range(40)]
    assert tuples(line_dedup.drop_repeated_lines(documents(spark, rows), least=10)) == sorted(((i, *w) for (i, _), w in zip(rows, plain_lines([t for _, t in rows], 10), strict=True)), key=str)


def test_twice_filters_miss_no_repeat_and_few_others_pass():
    rng = np.random.default_rng(3)
    values = np.unique(rng.integers(0, 1 << 63, 60_000, dtype=np.uint64))
    repeated, rest = values[:4000], values[4000:]
    blocks = [np.concatenate([repeated, part]) for part in np.array_split(rest, 4)]
    bits = len(values) * line_dedup.TWICE_BITS // 8 * 8
    packed = np.frombuffer(line_dedup.twice_filter(blocks, [np.zeros(len(b), bool) for b in blocks], bits).tobytes(), np.uint8)
    assert line_dedup.in_filter(packed, repeated, 1, bits).all()
    assert line_dedup.in_filter(packed, rest, 1, bits).mean() < 0.05


# ---- k-means ----

def plain_kmeans(rows, k, rounds, dims, scale=1024, seed=3):
    """Python integers, every vector against every centroid."""
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted((hashlib.sha256(f"{seed}:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)[:k]
    centroids = [v for _, v in first]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), n) for n, c in enumerate(centroids))

    for _ in range(rounds):
        held = collections.defaultdict(list)
        for _, v in kept:
            held[nearest(v)[1]].append(v)
        centroids = [[sum(c) // len(held[n]) for c in zip(*held[n], strict=True)] if held[n] else centroids[n] for n in range(len(centroids))]
    found = [(i, *nearest(v)[::-1]) for i, v in kept]
    own = collections.Counter()
    for _, c, d in found:
        own[c] += d
    return [(i, c, d, own[c], sum(own.values()), hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest()) for i, c, d in found]


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, "x", 1, b"y") for i, v in rows], "vec_id long, embedding array<float>, cluster string, ids long, vectors binary")


@pytest.mark.parametrize("spread,tree,leaf", [(0.0, 64, 4), (0.05, 50, 8), (3.0, 16_384, 64)])
def test_kmeans_against_plain_integers(spark, spread, tree, leaf):
    rng = np.random.default_rng(11)
    centres = rng.normal(size=(6, 5))
    x = (centres[rng.integers(0, 6, 400)] + spread * rng.normal(size=(400, 5))).astype(np.float32)
    rows = [(i, v) for i, v in enumerate(x.tolist())] + [(3, x[3].tolist()), (None, x[9].tolist()), (None, None), (900, [1.0]), (901, []), (902, [1.0, None, 0.0, 0.0, 0.0]), (903, [1.0, float("nan"), 0.0, 0.0, 0.0]), (904, [float("inf")] * 5)]
    found = kdtree.cluster_vectors(vectors(spark, rows).repartition(5), k=4, rounds=4, dims=5, tree=tree, leaf=leaf)
    assert tuples(found) == sorted(plain_kmeans(rows, 4, 4, 5), key=str)


def test_ties_go_to_the_smaller_centroid_and_empty_clusters_stay(spark):
    rows = [(i, [float(i % 2), 0.0]) for i in range(30)] + [(100, [0.5, 0.0])] * 3
    found = kdtree.cluster_vectors(vectors(spark, rows), k=8, rounds=3, dims=2, tree=7, leaf=2)
    assert tuples(found) == sorted(plain_kmeans(rows, 8, 3, 2), key=str)


def test_fewer_vectors_than_centroids_and_none(spark):
    rows = [(7, [1.0, -1.0]), (8, [0.25, 0.5])]
    assert tuples(kdtree.cluster_vectors(vectors(spark, rows), dims=2)) == sorted(plain_kmeans(rows, 8, 10, 2), key=str)
    assert kdtree.cluster_vectors(vectors(spark, [])).collect() == []
    assert kdtree.cluster_vectors(vectors(spark, [(1, None), (2, [1.0])])).collect() == []


def test_large_components_are_exact_or_held(spark):
    rows = [(i, [float(v), float(-v)]) for i, v in enumerate([5e3, 5.0001e3, 9e4, 1e5, 1.2e5, 7.0])]
    assert tuples(kdtree.cluster_vectors(vectors(spark, rows), k=2, rounds=3, dims=2)) == sorted(plain_kmeans(rows, 2, 3, 2), key=str)
    assert kdtree.cluster_vectors(vectors(spark, [(1, [3e38, 0.0]), (2, [-3e38, 0.0])]), k=1, rounds=1, dims=2).count() == 2


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 1 << 30), st.integers(1, 40), st.integers(1, 6))
def test_pruning_keeps_every_nearest_centroid(seed, n, k):
    rng = np.random.default_rng(seed)
    x, centroids = rng.integers(-6, 6, (n, 3)), rng.integers(-6, 6, (k, 3))
    order, nodes = kdtree.kd_tree(x, 3)
    x = x[order]
    labels, far = np.full(n, -1), np.zeros(n, np.int64)

    def whole(node, c):
        own = slice(nodes["start"][node], nodes["stop"][node])
        labels[own], far[own] = c, kdtree.distances(x[own], centroids[c : c + 1])[:, 0]
        assert (nodes["sum"][node] == x[own].sum(axis=0)).all() and int(nodes["squares"][node]) == int((x[own] ** 2).sum())

    def single(start, stop, found, d):
        labels[start:stop], far[start:stop] = found, d

    kdtree.walk(x, nodes, centroids, whole, single)
    exact = ((x[:, None, :] - centroids[None]) ** 2).sum(axis=2)
    assert (labels == exact.argmin(axis=1)).all() and (far == exact.min(axis=1)).all()


# ---- alignment ----

@pytest.fixture(scope="module")
def plain_alignment():
    import sentencepiece
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(A_PATH), sentencepiece.SentencePieceProcessor(model_file=B_PATH)
    a.encode_special_tokens = True
    alphabet = alignment.byte_alphabet()
    of_a = {i: bytes(alphabet[c] for c in t) for t, i in a.get_vocab().items()}
    of_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in range(b.get_piece_size())]

    def one(text):
        """Tokens, groups and links of a whole text encoded at once, by walking along both sides."""
        if not text:
            return [], [], [], []
        ids_a, ids_b, raw = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text), (" " + text).encode()
        if b"".join(of_a[t] for t in ids_a) != raw or b"".join(of_b[t] for t in ids_b) != raw:
            return [], [], [], []
        ends_a, ends_b = np.cumsum([len(of_a[t]) for t in ids_a]).tolist(), np.cumsum([len(of_b[t]) for t in ids_b]).tolist()
        shown, before = [], 0
        for end in sorted(set(ends_a) & set(ends_b)):
            sides = [",".join(str(t) for t, e in zip(ids, ends, strict=True) if before < e <= end) for ids, ends in ((ids_a, ends_a), (ids_b, ends_b))]
            shown.append("|".join(sides))
            before = end
        links, i, j = [], 0, 0
        while i < len(ids_a):
            links.append((ids_a[i], ids_b[j]))
            i, j = i + (ends_a[i] <= ends_b[j]), j + (ends_b[j] <= ends_a[i])
        return ids_a, ids_b, shown, links

    def run(rows):
        found = [(i, *one(t)) for i, t in rows]
        counts = collections.Counter(x for f in found for x in f[4])
        best = collections.Counter()
        for (_, t), n in counts.items():
            best[t] = max(best[t], n)
        return [
            (i, len(x), len(y), len(g), len(links), sum(counts[p] == best[p[1]] for p in links), sum(counts[p] for p in links), hashlib.sha256(";".join(g).encode()).hexdigest() if g else "")
            for i, x, y, g, links in found
        ]

    run.one = one
    return run


ODD_TEXTS = [
    None, "", " ", "\n", "a  b", "\n\nfoo", " x<|endoftext|>y", "tab\there", "é fiﬁ ▁x", "a\x00b", "  lead", "trail \n", "trail ", "<s> hi </s>", "﻿x", "a　b c", "​", "x\r\ny z", "a\n b", "a \nb c",
    "a\x1c b\x85 c\xa0 d", "'s it's 's", "日本語 テキスト\n日本 🎉🎉 x", "a   b", "x y\n", " \n ", "▁ ▁a b", "plain words here\nand there", "plain words here\nand there", "w" * 5000, "straße Übergröße\tniño", "<|endoftext|>", "a<unk>b <0x41>",
]


def test_alignment_against_whole_texts(spark, plain_alignment):
    rows = list(enumerate(ODD_TEXTS)) + [(None, "plain words"), (None, None), (27, ODD_TEXTS[27]), (500, " ".join(f"w{i} Wort{i % 50},\n"[: 6 + i % 9] for i in range(6000)))]
    found = alignment.align(documents(spark, rows).repartition(3), A_PATH, B_PATH)
    assert tuples(found) == sorted(plain_alignment(rows), key=str)


def test_alignment_forgets_and_learns_again(spark, plain_alignment, monkeypatch):
    monkeypatch.setattr(alignment, "REMEMBERED", 30)
    monkeypatch.setattr(alignment, "STRETCH", 400)
    rows = [(i, " ".join(f"word{(i * k) % 97}" for k in range(20))) for i in range(60)]
    assert tuples(alignment.align(documents(spark, rows), A_PATH, B_PATH)) == sorted(plain_alignment(rows), key=str)


def test_groups_are_those_of_common_ends(spark, plain_alignment):
    rows = [(i, t) for i, t in enumerate(ODD_TEXTS)]
    found = dict(map(tuple, alignment.aligned_groups(documents(spark, rows), A_PATH, B_PATH).collect()))
    assert found == {i: ";".join(plain_alignment.one(t)[2]) for i, t in rows}


def test_answers_of_stretches_are_sorted_and_not_gathered(spark):
    """No task of Spark's holds the answers of several stretches as objects, however many stretches come to a partition."""
    found = alignment.align(documents(spark, [(1, "some words"), (2, None)]), A_PATH, B_PATH)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan and "FlatMapCoGroupsInArrow" in plan


@pytest.mark.parametrize("arrays", [[[], []], [[1, 2], []], [[-5, 7 << 40], [3]], [list(range(70000)), [0], []]])
def test_blocks_come_back(arrays):
    found = alignment.unpacked(alignment.packed(*(np.array(a, np.int64) for a in arrays)))
    assert [f.tolist() for f in found] == arrays


def test_alignment_of_an_empty_table(spark):
    assert alignment.align(documents(spark, []), A_PATH, B_PATH).collect() == []


@pytest.fixture(scope="module")
def aligner():
    return alignment.Aligner(A_PATH, B_PATH)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab .,\n\t'é▁日　\x1c\x85🎉", max_size=30))
def test_units_are_borders_of_both_tokenizers(plain_alignment, aligner, text):
    assert "".join(alignment.units_of(text)) == " " + text
    units = aligner.units([text])[0].tolist()
    assert "".join(aligner.texts[u] for u in units)[:-1] == ";".join(plain_alignment.one(text)[2])
