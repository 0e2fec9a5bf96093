"""The count model against a row-by-row restatement; probabilities of a context sum to 1."""

import math
import random
from collections import Counter, defaultdict

import pytest

from lexforge.operators import ngram_lm


class Brute:
    def __init__(self, texts, d=0.75):
        self.d, self.tri = d, Counter()
        for t in texts:
            p = ["<s>", "<s>", *(t or "").lower().split(), "</s>"]
            self.tri.update(zip(p, p[1:], p[2:], strict=False))
        self.bi = Counter((v, w) for _, v, w in self.tri)
        self.word = Counter(w for _, w in self.bi)
        self.ctx3, self.ctx2 = defaultdict(list), defaultdict(list)
        for (u, v, _), c in self.tri.items():
            self.ctx3[u, v].append(c)
        for (v, _), c in self.bi.items():
            self.ctx2[v].append(c)

    def p(self, u, v, w):
        total, types, d = sum(self.word.values()), len(self.word), self.d
        out = max(self.word[w] - d, 0) / total + d * types / total / (types + 1) if total else 1 / (types + 1)
        for count, ctx in ((self.bi[v, w], self.ctx2.get(v)), (self.tri[u, v, w], self.ctx3.get((u, v)))):
            if ctx:
                out = max(count - d, 0) / sum(ctx) + d * len(ctx) / sum(ctx) * out
        return out


def test_probabilities(spark):
    rng = random.Random(2)
    texts = [" ".join(rng.choice("a b c d e Foo".split()) for _ in range(rng.randint(0, 12))) for _ in range(60)] + [None, "", "a a a a"]
    frame = lambda rows: spark.createDataFrame(list(enumerate(rows)), "id int, text string")
    model, brute = ngram_lm.train(frame(texts)), Brute(texts)
    held = ["a b zz foo", "zz zz", "", None, "e d c b a"]
    got = {r["id"]: (r["nll"], r["targets"]) for r in ngram_lm.nll(model, frame(held), ["id"]).collect()}
    for i, t in enumerate(held):
        p = ["<s>", "<s>", *(t or "").lower().split(), "</s>"]
        assert got[i] == (pytest.approx(sum(-math.log(brute.p(*x)) for x in zip(p, p[1:], p[2:], strict=False))), len(p) - 2)
    words = [*brute.word, "never seen"]
    asked = spark.createDataFrame([(u, v, w) for u, v in (("a", "b"), ("zz", "a"), ("zz", "zz"), ("<s>", "<s>")) for w in words], "u string, v string, w string")
    sums = defaultdict(float)
    for r in ngram_lm.probabilities(model, asked).collect():
        sums[r["u"], r["v"]] += r["p"]
    assert list(sums.values()) == pytest.approx([1.0] * 4)
    empty = ngram_lm.nll(ngram_lm.train(frame([]).limit(0)), frame(["x"]), ["id"]).first()
    assert (empty["nll"], empty["targets"]) == (pytest.approx(0.0), 2)  # one unknown word is all there is


def test_continuations_are_cut(spark):
    texts = ["a b c d", "a b d", "c a b"]
    model, brute = ngram_lm.train(spark.createDataFrame([(t,) for t in texts], "text string")), Brute(texts)
    rows = [(0, "a b", "c d"), (1, "x y z a b", "c"), (2, "", "a b"), (3, "a", ""), (4, "q", "a b c d a"), (5, None, None)]
    got = {r["id"]: r for r in ngram_lm.continuations(model, spark.createDataFrame(rows, "id int, c string, k string"), ["id"], "c", "k", 4).collect()}
    want = {0: (["a", "b"], ["c", "d"], False), 1: (["z", "a", "b"], ["c"], True), 2: ([], ["a", "b"], False), 3: (["a"], [], False), 4: ([], ["b", "c", "d", "a"], True), 5: ([], [], False)}
    for i, (head, own, cut) in want.items():
        p = ["<s>", "<s>", *head, *own]
        scored = list(zip(p, p[1:], p[2:], strict=False))[len(head) :]
        assert (got[i]["loglik"], got[i]["n_tokens"], got[i]["truncated"]) == (pytest.approx(sum(math.log(brute.p(*x)) for x in scored)), len(own), cut)


def shuffled(spark) -> int:
    """Bytes that the session's stages have written to shuffles."""
    context = spark.sparkContext
    stages = context._jsc.sc().statusStore().stageList(None, False, False, context._gateway.new_array(context._jvm.double, 0), None)
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


@pytest.mark.parametrize("asking", ["nll", "continuations"])
def test_shuffles_little_more_than_the_texts(spark, asking):
    rng = random.Random(5)
    known = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(20_000)]
    texts = [(i, " ".join(known[int(rng.paretovariate(0.6)) % len(known)] for _ in range(300))) for i in range(1500)]
    frame = spark.createDataFrame(texts, "id int, text string")
    before = shuffled(spark)
    model = ngram_lm.train(frame.filter("id % 10 != 0"))
    if asking == "nll":
        ngram_lm.nll(model, frame.filter("id % 10 = 0"), ["id"]).collect()
    else:
        ngram_lm.continuations(model, spark.createDataFrame([(0, texts[0][1], texts[1][1])], "id int, c string, k string"), ["id"], "c", "k", 24).collect()
    times = (shuffled(spark) - before) / sum(len(t) for _, t in texts)
    assert times < 1.6, times


def test_words_of_a_bucket_travel_once():
    """Lines are numbers of a bucket's words: what is read as text follows its different words, not its lines."""
    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(4)
    known = [f"{'word' * 5}{i}" for i in range(300)]
    codes, nums = rng.integers(0, 300, (3, 40_000)), [rng.integers(0, most, 40_000) for most in (3, 1 << 40)]
    at = rng.integers(0, 5, 40_000)
    tags = pa.array([f"t{x}" for x in codes[0]])
    sent = ngram_lm._packed(at, ngram_lm.ASKED, pa.array(known), list(codes), nums, tags)
    assert sum(len(x) for x in sent["words"].to_pylist()) == 5 * (sum(len(x) + 1 for x in known) - 1)
    plain = ngram_lm._packed(at, ngram_lm.COUNTS, pa.array(known), list(codes), nums[:1])
    assert plain.nbytes < 10 * 40_000, plain.nbytes  # 3 words of 23 letters a line as text
    got = []
    for row in range(sent.num_rows):
        words, ((own, of, own_tags),) = ngram_lm._lines(pa.Table.from_batches([plain, sent.slice(row, 1)]), (ngram_lm.ASKED, 3))
        got += zip([row] * len(own_tags), *[[words[i].as_py() for i in x] for x in own], *of.tolist(), own_tags.to_pylist(), strict=True)
    assert sorted(got) == sorted(zip(at.tolist(), *[[known[i] for i in x] for x in codes], *[x.tolist() for x in nums], tags.to_pylist(), strict=True))


def test_rows_of_large_numbers_keep_their_order():
    import numpy as np

    rng = np.random.default_rng(6)
    columns = [rng.integers(0, most, 2000) for most in (3, 1 << 40, 2, 1 << 45, 1 << 50)]
    ids = ngram_lm._ids(*columns)
    rows = list(zip(*columns, strict=True))
    assert [rows[i] for i in np.argsort(ids)] == sorted(rows)
    assert len(set(ids.tolist())) == len(set(rows))
