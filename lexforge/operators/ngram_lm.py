"""A language model of counts: interpolated Kneser-Ney over words.

Trigrams of a text, with two start marks before it and one end mark behind, are counted; bigrams and words count in how many contexts they
occur. Each order takes a discount off its counts and gives what it takes to the order below; the lowest is even over the vocabulary and one unknown
word. So every token has a probability above 0, and those of a context sum to 1.

Trigrams are counted within a few MB of texts and meet the trigrams that are asked for in buckets: by (v, u), where their contexts are summed; then
their bigrams by (v, w), their words by v and by w, and the asked ones by w. Between, lines of a bucket travel as one row: its words once, and the lines
as numbers of those, so that a bucket's words and not its lines are read as text. Buckets grow in number with the texts, not in size; only those that
hold a frequent word's asked trigrams are larger.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.written import written

DISCOUNT = 0.75
START, END = "<s>", "</s>"
WORDS = r"[\p{L}\p{M}\p{Nd}]+"
#: Bytes of texts whose trigrams are counted together before they are dealt, and for which there is one bucket. Bigrams and words take fewer.
BATCH_BYTES, BUCKET_BYTES, OF_BIGRAMS, OF_WORDS = 8 << 20, 8 << 20, 2, 4
#: Lines of one kind and bucket: counts (0), asked trigrams (1), words (2), or their sum and number (3, in the tags). Words are parted by spaces, tags by
#: line ends; codes are places in the words, nums what is known of the lines, both column by column; of first words, mostly in order, the steps are kept.
PACKED = "at int, kind int, words string, codes binary, nums binary, tags string"
COUNTS, ASKED, SINGLE, WHOLE = 0, 1, 2, 3


@dataclass
class Model:
    """Counted trigrams (v, u, w, c), packed, in so many buckets; each asking sums the counts that it needs of them."""

    grams: DataFrame
    buckets: int
    discount: float


def words(text: Column) -> Column:
    """Words in lower case; of a null text none."""
    return F.coalesce(F.regexp_extract_all(F.lower(text), F.lit(WORDS), F.lit(0)), F.array().cast("array<string>"))


def trigrams(items: Column, end: bool = True) -> Column:
    """(u, v, w) of every token of an array, the end mark among them."""
    padded = F.concat(F.array(F.lit(START), F.lit(START)), items, F.array(F.lit(END)) if end else F.array().cast("array<string>"))
    n = F.size(items) + int(end)
    return F.arrays_zip(*[F.slice(padded, i, n) for i in (1, 2, 3)]).cast("array<struct<u:string,v:string,w:string>>")


# --- lines of a bucket ---------------------------------------------------------------------------------------------------------------


def _ids(*columns):
    """A number a row of integers, ordered as the rows are and equal where they are."""
    import numpy as np

    ids, size = np.zeros(len(columns[0]), np.int64), 1
    for c in columns:
        width = int(c.max(initial=0)) + 1
        if size * width >= 1 << 62:
            ids = np.unique(ids, return_inverse=True)[1]
            size = int(ids.max(initial=0)) + 1
        ids, size = ids * width + c, size * width
    return ids


def _starts(ids):
    """Where runs of equal ids start, of ids in order."""
    import numpy as np

    return np.flatnonzero(np.diff(ids, prepend=-1))


def _lengths(starts, n: int):
    import numpy as np

    return np.diff(starts, append=n)


def _looked_up(ids, asked, *values):
    """Values of asked ids among different ids in order, 0 where they aren't."""
    import numpy as np

    at = np.searchsorted(ids, asked)
    known = np.flatnonzero(at < len(ids))
    known = known[ids[at[known]] == asked[known]]
    out = [np.zeros(len(asked), np.int64) for _ in values]
    for x, value in zip(out, values, strict=True):
        x[known] = value[at[known]]
    return out


def _sums(number, values, size: int):
    import numpy as np

    return np.bincount(number, values, size).astype(np.int64)


def _hashes(vocabulary):
    from pandas.util import hash_array

    return hash_array(vocabulary.to_numpy(zero_copy_only=False), categorize=False)


def _bucket(hashes, buckets: int, *codes):
    import numpy as np

    mixed = np.zeros(len(codes[0]), np.uint64)
    for c in codes:
        mixed = mixed * np.uint64(0x9E3779B1) + hashes[c]
    return (mixed % np.uint64(buckets)).astype(np.int64)


def _planes(values) -> bytes:
    """Whole numbers from 0 as how many bytes the largest takes, then their lowest bytes, then their second ones and so on, which compress well."""
    import numpy as np

    n = max(1, (int(values.max(initial=0)).bit_length() + 7) // 8)
    return bytes([n]) + values.astype("<i8").view(np.uint8).reshape(-1, 8).T[:n].tobytes()


def _values(planes: bytes):
    import numpy as np

    kept = np.frombuffer(planes, np.uint8, offset=1).reshape(planes[0], -1)
    out = np.zeros((kept.shape[1], 8), np.uint8)
    out[:, : len(kept)] = kept.T
    return out.view("<i8").ravel()


def _packed(at, kind: int, vocabulary, codes, nums, tags=None):
    """A row a bucket of lines of words (columns of places in the vocabulary) and numbers, in their order."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    order = np.argsort(at.astype(np.uint16) if at.max(initial=0) < 1 << 16 else at, kind="stable")
    starts = _starts(at[order])
    ends = [*starts[1:].tolist(), len(at)][: len(starts)]
    codes, nums = np.stack(codes)[:, order], np.stack(nums)[:, order]
    place = np.empty(len(vocabulary), np.int64)
    words, of_codes, of_nums = [], [], []
    for start, end in zip(starts.tolist(), ends, strict=True):
        own = codes[:, start:end].ravel()
        each = np.arange(len(own))
        place[own] = each
        different = np.sort(own[place[own] == each])
        place[different] = np.arange(len(different))
        words.append(different)
        own = place[own]
        step = np.diff(own[: end - start], prepend=0)
        own[: end - start] = step << 1 ^ step >> 63  # a step back is odd
        of_codes.append(_planes(own))
        of_nums.append(_planes(nums[:, start:end].ravel()))

    def joined(values, ends, by):
        return pc.binary_join(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), values), by)

    of_words = joined(vocabulary.take(pa.array(np.concatenate(words or [order]))), np.cumsum([len(x) for x in words]), " ")
    of_tags = pa.nulls(len(starts), pa.string()) if tags is None else joined(tags.take(pa.array(order)), ends, "\n")
    columns = [pa.array(at[order][starts], pa.int32()), pa.array(np.full(len(starts), kind), pa.int32()), of_words, pa.array(of_codes, pa.binary()), pa.array(of_nums, pa.binary()), of_tags]
    return pa.RecordBatch.from_arrays(columns, ["at", "kind", "words", "codes", "nums", "tags"])


def _lines(table, *wide):
    """The vocabulary of a bucket, and of each (kind, words a line) the lines' codes and numbers by column, and their tags."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    def flat(column, by):
        values = column.combine_chunks()
        parts = pc.split_pattern(values, by)
        return (pc.list_flatten(parts), pc.list_value_length(parts).to_numpy()) if len(values) else (pa.array([], pa.string()), np.zeros(0, np.int64))

    table = table.filter(pc.is_in(table["kind"], pa.array([kind for kind, _ in wide], pa.int32())))
    texts, n = flat(table["words"], " ")
    coded = texts.dictionary_encode()
    known, before, kinds = coded.indices.to_numpy().astype(np.int64), np.cumsum(n) - n, table["kind"].to_numpy()
    codes, nums, out = table["codes"].to_pylist(), table["nums"].to_pylist(), []
    for kind, each in wide:
        rows = np.flatnonzero(kinds == kind).tolist()
        own = [_values(codes[i]).reshape(each, -1) for i in rows]
        for i, x in zip(rows, own, strict=True):
            x[0] = np.cumsum(x[0] >> 1 ^ -(x[0] & 1))
            x += before[i]
        of = [_values(nums[i]).reshape(-1, x.shape[1]) for i, x in zip(rows, own, strict=True)]
        tags = flat(table["tags"].take(pa.array(rows, pa.int64())), "\n")[0] if kind == ASKED else None
        out.append((known[np.concatenate(own, 1)] if rows else np.zeros((each, 0), np.int64), np.concatenate(of, 1) if rows else np.zeros((3, 0), np.int64), tags))
    return coded.dictionary, out


def _of_texts(kind: int, buckets: int):
    """Trigrams of texts in lower case (text, tag), counted within a few MB of them."""

    def count(texts, tags):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        pieces = pc.ascii_split_whitespace(texts.fill_null(""))  # the pattern, which is slow, sees each different piece once
        coded = pc.list_flatten(pieces).dictionary_encode()
        piece = coded.indices.to_numpy()
        parts = pc.split_pattern_regex(coded.dictionary, pattern="[^" + WORDS[1:])
        flat = pc.list_flatten(parts)
        full = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)
        each = np.bincount(pc.list_parent_indices(parts).to_numpy()[full], minlength=len(coded.dictionary))
        coded = flat.filter(pa.array(full)).dictionary_encode()
        times = each[piece]
        found = np.repeat((np.cumsum(each) - each)[piece] - (np.cumsum(times) - times), times) + np.arange(times.sum())
        n = np.bincount(np.repeat(pc.list_parent_indices(pieces).to_numpy(), times), minlength=len(texts))
        vocabulary = pa.concat_arrays([coded.dictionary, pa.array([START, END])])
        ends = np.cumsum(n + 3)  # of each text with its marks
        marks = np.zeros(ends[-1], bool)
        marks[ends - 1] = marks[ends - n - 3] = marks[ends - n - 2] = True
        padded = np.full(len(marks), len(vocabulary) - 2, np.int64)
        padded[~marks] = coded.indices.to_numpy()[found]
        padded[ends - 1] = len(vocabulary) - 1
        starts = np.ones(len(marks), bool)
        starts[ends - 1] = starts[ends - 2] = False
        at = np.flatnonzero(starts)
        u, v, w = padded[at], padded[at + 1], padded[at + 2]
        if kind == ASKED:
            tagged = tags.dictionary_encode()
            tag = np.repeat(tagged.indices.to_numpy().astype(np.int64), n + 1)
        else:
            tag = np.zeros(len(at), np.int64)
        ids = _ids(tag, v, u, w)
        order = np.argsort(ids)
        starts = _starts(ids[order])
        first, c = order[starts], _lengths(starts, len(order))
        tag, u, v, w = tag[first], u[first], v[first], w[first]
        return _packed(_bucket(_hashes(vocabulary), buckets, v, u), kind, vocabulary, [v, u, w], [c], tagged.dictionary.take(pa.array(tag)) if kind == ASKED else None)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import pyarrow.compute as pc

        held, size = [], 0
        for batch in batches:
            start = 0
            for i, n in enumerate(pc.binary_length(batch.column(0)).fill_null(0).to_pylist(), 1):
                size += n + 8  # texts without words have an end, too
                if size >= BATCH_BYTES:
                    yield count(*[x.combine_chunks() for x in pa.Table.from_batches([*held, batch.slice(start, i - start)]).columns])
                    held, size, start = [], 0, i
            held.append(batch.slice(start))
        if size:
            yield count(*[x.combine_chunks() for x in pa.Table.from_batches(held).columns])

    return run


def _of_rows(buckets: int):
    """Asked rows (tag, u, v, w, n), packed."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            if batch.num_rows:
                coded = pa.concat_arrays([batch.column(x) for x in ("u", "v", "w")]).dictionary_encode()
                u, v, w = coded.indices.to_numpy().astype(np.int64).reshape(3, -1)
                yield _packed(_bucket(_hashes(coded.dictionary), buckets, v, u), ASKED, coded.dictionary, [v, u, w], [batch.column("n").to_numpy()], batch.column("tag"))

    return run


# --- what lines of a bucket find there -----------------------------------------------------------------------------------------------


def _by_context(onward: int):
    """By (v, u): trigrams are summed, asked ones get (count, total and types of the context); bigrams go on."""

    def run(table):
        import numpy as np
        import pyarrow as pa

        vocabulary, (((v, u, w), (c, *_), _), ((av, au, aw), asked, tags)) = _lines(table, (COUNTS, 3), (ASKED, 3))
        n, hashes = len(v), _hashes(vocabulary)
        ids = _ids(np.concatenate([v, av]), np.concatenate([u, au]), np.concatenate([w, aw]))
        order = np.argsort(ids[:n])
        starts = _starts(ids[order])
        first = order[starts]
        c, v, u, w = np.add.reduceat(c[order], starts), v[first], u[first], w[first]
        (count,) = _looked_up(ids[first], ids[n:], c)
        n = len(v)
        ids = _ids(np.concatenate([v, av]), np.concatenate([u, au]))  # in order, as the trigrams are
        starts = _starts(ids[:n])
        total, types = _looked_up(ids[starts], ids[n:], np.add.reduceat(c, starts), _lengths(starts, n))
        out = [_packed(_bucket(hashes, onward, av, aw), ASKED, vocabulary, [av, au, aw], [asked[0], count, total, types], tags)]
        ids = _ids(v, w)
        order = np.argsort(ids)
        starts = _starts(ids[order])
        v, w = v[order[starts]], w[order[starts]]
        return pa.Table.from_batches([*out, _packed(_bucket(hashes, onward, v, w), COUNTS, vocabulary, [v, w], [_lengths(starts, n)])])

    return run


def _by_bigram(onward: int):
    """By (v, w): bigrams are summed, asked ones get their count; sums by v and numbers by w go on."""

    def run(table):
        import numpy as np
        import pyarrow as pa

        vocabulary, (((v, w), (c, *_), _), ((av, au, aw), asked, tags)) = _lines(table, (COUNTS, 2), (ASKED, 3))
        n, hashes, size = len(v), _hashes(vocabulary), len(vocabulary)
        ids = _ids(np.concatenate([v, av]), np.concatenate([w, aw]))
        order = np.argsort(ids[:n])
        starts = _starts(ids[order])
        first, c = order[starts], np.add.reduceat(c[order], starts)
        (count,) = _looked_up(ids[first], ids[n:], c)
        out = [_packed(_bucket(hashes, onward, av), ASKED, vocabulary, [av, au, aw], [*asked, count], tags)]
        v, w = v[first], w[first]
        total, types, before = _sums(v, c, size), _sums(v, None, size), _sums(w, None, size)
        v, w = np.flatnonzero(types), np.flatnonzero(before)
        out.append(_packed(_bucket(hashes, onward, v), COUNTS, vocabulary, [v], [total[v], types[v]]))
        return pa.Table.from_batches([*out, _packed(_bucket(hashes, onward, w), SINGLE, vocabulary, [w], [before[w]])])

    return run


def _by_words(onward: int):
    """By v: asked ones get total and types. By w: numbers are summed and go on."""

    def run(table):
        import numpy as np
        import pyarrow as pa

        vocabulary, (((v,), nums, _), ((av, au, aw), asked, tags), ((w,), before, _)) = _lines(table, (COUNTS, 1), (ASKED, 3), (SINGLE, 1))
        hashes, size = _hashes(vocabulary), len(vocabulary)
        total, types = _sums(v, nums[0], size), _sums(v, nums[1], size)
        out = [_packed(_bucket(hashes, onward, aw), ASKED, vocabulary, [av, au, aw], [*asked, total[av], types[av]], tags)]
        before = _sums(w, before[0], size)
        w = np.flatnonzero(before)
        out.append(_packed(_bucket(hashes, onward, w), COUNTS, vocabulary, [w], [before[w]]))
        whole = [pa.array([0], pa.int32()), pa.array([WHOLE], pa.int32()), pa.nulls(1, pa.string()), pa.nulls(1, pa.binary()), pa.nulls(1, pa.binary()), pa.array([f"{before.sum()} {len(w)}"])]
        return pa.Table.from_batches([*out, pa.RecordBatch.from_arrays(whole, out[0].schema.names)])

    return run


def _by_last(total: int, types: int, d: float, each: bool):
    """By w: what asked trigrams have found gives their p: a row each, or sums of n * ln p, and of n, by tag."""

    def run(table):
        import numpy as np
        import pyarrow as pa

        vocabulary, (((w,), (c, *_), _), ((av, au, aw), asked, tags)) = _lines(table, (COUNTS, 1), (ASKED, 3))
        n, c3, total3, types3, c2, total2, types2 = asked if len(aw) else [np.zeros(0, np.int64)] * 7
        c1 = _sums(w, c, len(vocabulary))[aw]
        p = np.full(len(aw), 1.0 / (types + 1))
        for c, of, kinds in ((c1, np.full(len(aw), total), types), (c2, total2, types2), (c3, total3, types3)):
            p = np.where(of > 0, (np.maximum(c - d, 0.0) + d * kinds * p) / np.maximum(of, 1), p)
        if each:
            return pa.table([*[vocabulary.take(pa.array(x)) for x in (au, av, aw)], pa.array(p)], names=["u", "v", "w", "p"])
        tagged = tags.dictionary_encode()
        tag = tagged.indices.to_numpy()
        return pa.table([tagged.dictionary, *[pa.array(np.bincount(tag, x, len(tagged.dictionary)).astype(np.float64)) for x in (n * np.log(p), n)]], names=["tag", "loglik", "n"])

    return run


# --- the model -----------------------------------------------------------------------------------------------------------------------


def train(texts: DataFrame, text: str = "text", discount: float = DISCOUNT) -> Model:
    size = texts.agg(F.sum(F.octet_length(F.col(text)))).first()[0] or 0
    buckets = max(8, -(-size // BUCKET_BYTES))
    lower = texts.select(F.lower(F.col(text)).alias("text"), F.lit(None).cast("string").alias("tag"))
    return Model(lower.mapInArrow(_of_texts(COUNTS, buckets), PACKED), buckets, discount)


def _told(model: Model, asked: DataFrame, each: bool = False) -> DataFrame:
    """Packed asked trigrams as rows (u, v, w, p), or sums (tag, loglik, n) of their n * ln p and n, some of each tag."""
    b = model.buckets
    of_bigrams, of_words = -(-b // OF_BIGRAMS), -(-b // OF_WORDS)
    met = lambda rows, n, run, kind=PACKED: rows.repartition(n, "at").groupBy("at").applyInArrow(run, kind)
    rows = met(met(model.grams.unionByName(asked), b, _by_context(of_bigrams)), of_bigrams, _by_bigram(of_words))
    found = written(met(rows, of_words, _by_words(of_words)))
    sums = F.split("tags", " ").cast("array<long>")
    total, types = found.filter(F.col("kind") == WHOLE).agg(*[F.coalesce(F.sum(sums[i]), F.lit(0)) for i in (0, 1)]).first()
    schema = "u string, v string, w string, p double" if each else "tag string, loglik double, n double"
    return met(found.filter(F.col("kind") != WHOLE), of_words, _by_last(total, types, model.discount, each), schema)


def _tag(keys: list[str]) -> Column:
    return F.to_json(F.struct(*keys)).alias("tag")


def _untagged(told: DataFrame, of: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, loglik, n) of sums by the tags that hold the keys."""
    sums = told.groupBy("tag").agg(F.sum("loglik").alias("loglik"), F.sum("n").cast("long").alias("n"))
    return sums.select(F.from_json("tag", T.StructType([of.schema[k] for k in keys])).alias("_k"), "loglik", "n").select("_k.*", "loglik", "n")


def probabilities(model: Model, asked: DataFrame) -> DataFrame:
    """asked (u, v, w, ...) with `p`, each trigram's probability of w after u, v. Trigrams are looked up once each."""
    safe = lambda c: F.when(F.col(c).rlike(r"[\s+%]"), F.url_encode(c)).otherwise(F.col(c)).alias(c)  # noqa: E731  no word of a text has these
    rows = asked.select(F.lit("").alias("tag"), safe("u"), safe("v"), safe("w"), F.lit(1).cast("long").alias("n")).dropna().distinct()
    told = _told(model, rows.mapInArrow(_of_rows(model.buckets), PACKED), each=True)
    return asked.join(told.select(*[F.url_decode(c).alias(c) for c in ("u", "v", "w")], "p"), ["u", "v", "w"])


def nll(model: Model, texts: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """(keys, nll, targets): the sum of -ln p over the tokens of each key's texts, their ends among them, and their number."""
    rows = texts.select(F.lower(F.col(text)).alias("text"), _tag(keys)).mapInArrow(_of_texts(ASKED, model.buckets), PACKED)
    return _untagged(_told(model, rows), texts, keys).select(*keys, (-F.col("loglik")).alias("nll"), F.col("n").alias("targets"))


def continuations(model: Model, rows: DataFrame, keys: list[str], context: str, continuation: str, most: int) -> DataFrame:
    """(keys, loglik, n_tokens, truncated) of continuations after contexts: only the continuation's tokens are scored. Of both together at
    most `most` tokens are kept, the context's first ones go, then the continuation's; an empty context is the start of a text."""
    both = rows.select(*keys, words(F.col(context)).alias("_c"), words(F.col(continuation)).alias("_k"))
    own = F.slice("_k", F.greatest(F.lit(1), F.size("_k") - most + 1), F.greatest(F.lit(0), F.least(F.size("_k"), F.lit(most))))
    room = F.lit(most) - F.size(own)
    head = F.slice("_c", F.greatest(F.lit(1), F.size("_c") - room + 1), F.greatest(F.lit(0), F.least(F.size("_c"), room)))
    cut = both.select(*keys, head.alias("_h"), own.alias("_o"), (F.size("_c") + F.size("_k") > most).alias("truncated"))
    cut = cut.select(*keys, "truncated", F.concat("_h", "_o").alias("_w"), F.size("_h").alias("_n"), F.size("_o").alias("_m"))
    each = F.slice(trigrams(F.col("_w"), end=False), F.col("_n") + 1, F.col("_m"))
    asked = cut.select(*keys, "truncated", F.explode_outer(each).alias("t")).select(*keys, "truncated", "t.*")
    rows = asked.filter("w is not null").select(_tag([*keys, "truncated"]), "u", "v", "w", F.lit(1).cast("long").alias("n"))
    told = _told(model, rows.mapInArrow(_of_rows(model.buckets), PACKED))
    scored = _untagged(told, cut, [*keys, "truncated"]).withColumnRenamed("n", "n_tokens")
    empty = asked.filter("w is null").select(*keys, "truncated", F.lit(0.0).alias("loglik"), F.lit(0).cast("long").alias("n_tokens"))
    return scored.unionByName(empty).select(*keys, "loglik", "n_tokens", "truncated")
