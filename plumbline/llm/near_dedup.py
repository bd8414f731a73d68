"""Near duplicates: consistent weighted samples of TF-IDF shingles, banded, then verified.

1. Document frequencies of shingles, hashed to a fixed number of counters.
2. Each document's improved consistent weighted samples, in bands; equal word
   sequences fold to one row first.
3. In each band's bucket the member that meets most others is the leader, and
   every other member is compared with it exactly.  Members unlike their leader
   meet again, under new leaders, in the finer buckets of two bands, then three.
4. Classes are the connected components of the links found.
5. Where a bucket still holds several classes, an exact prefix join of shingles
   finds every pair of its members that could link two of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import WordHashes, fresh, gram_hashes, mixed, utf8
from plumbline.session import materialize, release

#: Words of a shingle, least similarity, bands, samples of a band.  At 0.8 two
#: documents share a band with probability 1 - (1 - 0.8 ** 3) ** 10 = 0.999.
WORDS, SIMILARITY, BANDS, ROWS = 5, 0.8, 10, 3
#: Counters of document frequencies (2 MB, whatever the corpus); bands of the finest bucket.
COUNTERS, LEVELS = 1 << 18, 3
#: Allowance for the rounding of summed weights in bounds.
SLACK = 1e-9
#: Entries of the tables of random draws.
DRAWS = 1 << 16

_SKETCH = "uid long, doc_id long, same binary, keys array<long>, body binary"


def shingles(words: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles and how often each occurs; fewer than ``k`` words are one shingle."""
    grams = gram_hashes(words, min(k, len(words))) if len(words) else np.zeros(0, np.uint64)
    return np.unique(grams, return_counts=True)


def weigh(grams: np.ndarray, tf: np.ndarray, idf: np.ndarray) -> np.ndarray:
    return tf * idf[(grams & np.uint64(len(idf) - 1)).astype(np.int64)]


def weighted_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Of sorted distinct shingles with weights."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = np.minimum(a[1][i], b[1][j]).sum()
    either = a[1].sum() + b[1].sum() - both
    return float(both / either) if either > 0 else 1.0


def draws(seed: int = 11) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tables of r and ln c (both gamma of shape 2) and beta (uniform)."""
    rng = np.random.default_rng(seed)
    return rng.gamma(2.0, 1.0, DRAWS), np.log(rng.gamma(2.0, 1.0, DRAWS)), rng.random(DRAWS)


def weighted_samples(grams: np.ndarray, weights: np.ndarray, starts: np.ndarray, n: int, tables: tuple) -> np.ndarray:
    """``n`` consistent weighted samples, as hashes, of each run of ``grams`` that begins at ``starts``."""
    out = np.empty((n, len(starts)), np.uint64)
    sizes = np.diff(np.append(starts, len(grams)))
    log_w = np.log(weights)
    rng = np.random.default_rng(5)
    for k in range(n):
        at = ((grams * np.uint64(int(rng.integers(1 << 62)) * 2 + 1)) >> np.uint64(48)).astype(np.int64)
        r, log_c, beta = (t[at] for t in tables)
        t = np.floor(log_w / r + beta)
        log_a = log_c - r * (t - beta) - r
        least = np.minimum.reduceat(log_a, starts)
        hit = np.flatnonzero(log_a == np.repeat(least, sizes))
        # Of equal values (draws come from a table) the least hash is the sample.
        identity = mixed(grams[hit] + t[hit].astype(np.int64).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        out[k] = np.minimum.reduceat(identity, np.searchsorted(hit, starts))
    return out


def _frequencies(k: int):
    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Documents in which a counter's shingles occur, and all documents under counter -1."""
        counts, words, n = np.zeros(COUNTERS, np.int64), WordHashes(), 0
        for batch in batches:
            for raw in batch["text"].to_pylist():
                split = raw.split()
                grams = gram_hashes(words.of(split, len(split)), min(k, max(1, len(split))))
                counts[np.unique((grams & np.uint64(COUNTERS - 1)).astype(np.int32))] += 1
                n += 1
        found = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(found, -1), pa.int64()), pa.array(np.append(counts[found], n), pa.int64())], ["counter", "n"]
        )

    return frequencies


def inverse_frequencies(texts: DataFrame, k: int) -> np.ndarray:
    """A weight from 3/4 to 1 for each counter: the last quarter is the logarithmic inverse frequency.

    Damping it keeps a large group of near copies, whose shared shingles are frequent
    because of it, from falling apart over its few rare ones.
    """
    counted = texts.mapInArrow(_frequencies(k), "counter long, n long").groupBy("counter").agg(F.sum("n").alias("n"))
    table = counted.toArrow()
    counter, n = table["counter"].to_numpy(), table["n"].to_numpy()
    total = int(n[counter < 0].sum())
    df = np.zeros(COUNTERS)
    df[counter[counter >= 0]] = n[counter >= 0]
    return 0.75 + 0.25 * np.clip(np.log((1 + total) / (1 + df)) / np.log(2 + total), 0, 1)


def _sketches(k: int, bands: int, rows: int, idf):
    def sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, tables, weights = WordHashes(), draws(), idf.value
        n = TaskContext.get().partitionId() << 33
        for whole in batches:
            for first in range(0, whole.num_rows, 256):
                batch = whole.slice(first, 256)
                bodies, found = [], []
                for raw in batch["text"].to_pylist():
                    split = raw.split()
                    bodies.append(b" ".join(split))
                    found.append(shingles(words.of(split, len(split)), k))
                full = [i for i, (g, _) in enumerate(found) if len(g)]
                keys: list[list[int] | None] = [None] * len(found)
                if full:
                    grams = np.concatenate([found[i][0] for i in full])
                    tf = np.concatenate([found[i][1] for i in full])
                    starts = np.cumsum([0, *(len(found[i][0]) for i in full)])[:-1]
                    samples = weighted_samples(grams, weigh(grams, tf, weights), starts, bands * rows, tables)
                    for j in range(bands):
                        key = np.full(len(full), j + 1, np.uint64)
                        for row in samples[j * rows : (j + 1) * rows]:
                            key = mixed(key * np.uint64(0x100000001B3) + row)
                        for i, x in zip(full, key.view(np.int64).tolist(), strict=True):
                            keys[i] = (keys[i] or []) + [x]
                size = batch.num_rows
                yield pa.RecordBatch.from_arrays(
                    [pa.array(range(n, n + size), pa.int64()), batch["doc_id"], pa.array([xxhash.xxh128_digest(b) for b in bodies], pa.binary()),
                     pa.array(keys, pa.list_(pa.int64())), pa.array(bodies, pa.binary())],
                    ["uid", "doc_id", "same", "keys", "body"],
                )
                n += size

    return sketches


def _similarities(k: int, idf):
    def similarities(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, weights = WordHashes(), idf.value

        def vector(body: bytes) -> tuple[np.ndarray, np.ndarray]:
            split = body.split()
            grams, tf = shingles(words.of(split, len(split)), k)
            return grams, weigh(grams, tf, weights)

        last, led = None, None
        for whole in batches:
            for first in range(0, whole.num_rows, 256):
                batch, out = whole.slice(first, 256), []
                for leader, mine, theirs in zip(batch["leader"].to_pylist(), batch["mine"].to_pylist(), batch["theirs"], strict=True):
                    if leader != last:
                        last, led = leader, vector(theirs.as_py())
                    out.append(weighted_jaccard(vector(mine), led))
                yield pa.RecordBatch.from_arrays([batch["uid"], batch["leader"], pa.array(out, pa.float64())], ["uid", "leader", "similarity"])

    return similarities


_TOKENS = "uid long, label long, stray boolean, token long, w double"


def _tokens(k: int, idf):
    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each distinct shingle of each text, with its weight there."""
        words, weights = WordHashes(), idf.value
        for whole in batches:
            for first in range(0, whole.num_rows, 64):
                batch = whole.slice(first, 64)
                found = []
                for raw in batch["body"].to_pylist():
                    split = raw.split()
                    found.append(shingles(words.of(split, len(split)), k))
                counts = [len(g) for g, _ in found]
                grams, tf = (np.concatenate(c) for c in zip(*found, strict=True))
                own = [pa.array(np.repeat(batch[c].to_numpy(zero_copy_only=False), counts)) for c in ("uid", "label", "stray")]
                yield pa.RecordBatch.from_arrays([*own, pa.array(grams.view(np.int64)), pa.array(weigh(grams, tf, weights))], ["uid", "label", "stray", "token", "w"])

    return tokens


def _prefixes(tokens: DataFrame, similarity: float) -> DataFrame:
    """Rare shingles of each text that a text as similar, of another class, must share one of.

    Only shingles that texts of two classes have, a stray among them, can be shared.
    In one order of these, by the exact number of texts they are in, the first one that
    two texts share leaves both at least the overlap they need.  ``rest`` is the weight
    from a shingle on, ``small`` tells that it suffices for a partner no lighter, and
    ``before`` is the text's shingle before it in that order, null for the first.
    """
    counts = tokens.groupBy("token").agg(F.count("*").alias("n"), F.min("label").alias("least"), F.max("label").alias("most"), F.max("stray").alias("any"))
    shared = tokens.select("uid", "token", "w").hint("merge").join(counts.where("least < most and any").select("token", "n"), "token")
    last_first = Window.partitionBy("uid").orderBy(F.desc("n"), F.desc("token"))
    rest = F.sum("w").over(last_first.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ordered = shared.select("uid", "token", rest.alias("rest"), F.lead("token").over(last_first).alias("before"))
    texts = tokens.groupBy("uid").agg(F.first("label").alias("label"), F.first("stray").alias("stray"), F.sum("w").alias("weight"))
    enough = lambda share: F.col("rest") >= share * (1 - SLACK) * F.col("weight")
    prefixes = ordered.hint("merge").join(texts, "uid").where(enough(similarity))
    return prefixes.withColumn("small", enough(2 * similarity / (1 + similarity)))


def _compared(pairs: DataFrame, bodies: DataFrame, k: int, idf) -> DataFrame:
    """The similarity of each pair.  Both sides grow with the corpus, so the joins are by shuffle at every size."""
    mine = bodies.select("uid", F.col("body").alias("mine"))
    theirs = bodies.select(F.col("uid").alias("leader"), F.col("body").alias("theirs"))
    both = pairs.hint("merge").join(mine, "uid").hint("merge").join(theirs, "leader")
    both = both.select("uid", "leader", "mine", "theirs")
    return materialize(both.mapInArrow(_similarities(k, idf), "uid long, leader long, similarity double"), "compared")


def _starred(rows: DataFrame) -> DataFrame:
    """(set, uid, open, leader) for the members of every bucket of two or more.

    The score of a member is the number of others it meets.  The open member of
    the highest score leads all; the highest of those that have not led before
    leads the open ones.
    """
    size = rows.groupBy("set").agg(F.count("*").alias("size"), F.max("open").alias("any")).where("size > 1 and any")
    members = materialize(rows.join(size.drop("any"), "set"), "members")
    score = members.groupBy("uid").agg(F.sum("size").alias("score"))
    best = lambda which: F.max_by(F.col("uid"), F.when(which, F.struct("score", -F.col("uid"))))
    led = members.join(score, "uid").groupBy("set")
    led = led.agg(best(F.col("open")).alias("of_all"), F.max(F.when(~F.col("led"), F.struct("score", -F.col("uid")))).alias("of_open"))
    leaders = F.array_distinct(F.array_compact(F.array("of_all", F.when(F.col("open"), -F.col("of_open")["col2"]))))
    return members.join(led, "set").select("set", "uid", "open", "led", F.explode(leaders).alias("leader"))


def _finer(starred: DataFrame, links: DataFrame, base: DataFrame, level: int, bands: int) -> DataFrame:
    """The members of buckets with an open member, in the buckets of one band more."""
    state = starred.join(links.withColumn("linked", F.lit(True)), ["uid", "leader"], "left")
    leads = F.col("uid") == F.col("leader")
    met = F.max(F.coalesce("linked", F.lit(False)) | leads)
    state = state.groupBy("set", "uid").agg((F.max("open") & ~met).alias("open"), (F.max("led") | F.max(leads)).alias("led"))
    state = materialize(state, "open")
    active = state.join(state.where("open").select("set").distinct(), "set", "left_semi")
    mine = active.groupBy("uid").agg(
        F.collect_list("set").alias("mine"), F.max("open").alias("open"), F.collect_list(F.when(F.col("led"), F.col("set"))).alias("leading")
    )
    sets = F.array(*(F.array(*(F.get("keys", i) for i in c)) for c in combinations(range(bands), level + 1)))
    rows = mine.join(base, "uid").select("uid", "open", "mine", "leading", F.explode(sets).alias("set"))
    within = lambda s: F.size(F.array_except(s, F.col("set"))) == 0
    rows = rows.where(F.exists("mine", within)).select("set", "uid", "open", F.exists("leading", within).alias("led"))
    return materialize(rows, "finer")


def links_between(reps: DataFrame, bodies: DataFrame, similarity: float, k: int, idf, levels: int, bands: int = BANDS) -> tuple[DataFrame, ...]:
    """(uid, leader) of verified links between the rows of ``reps``, the first buckets, the texts of their members, and the pairs compared."""
    rows = reps.select(F.explode("keys").alias("key"), "uid").select(F.array("key").alias("set"), "uid", F.lit(True).alias("open"), F.lit(False).alias("led"))
    found, done, buckets = [], None, None
    for level in range(1, levels + 1):
        starred = materialize(_starred(rows), "starred")
        pairs = starred.where("uid <> leader").select("uid", "leader").distinct()
        if done is None:  # members of finer buckets are among those of the first
            buckets = starred.select("set", "uid", "leader")
            some = pairs.select(F.explode(F.array("uid", "leader")).alias("uid")).distinct()
            bodies = materialize(bodies.hint("merge").join(some, "uid", "left_semi"), "bodies")
        else:
            pairs = pairs.join(done, ["uid", "leader"], "left_anti")
        compared = _compared(pairs, bodies, k, idf)
        done = compared.select("uid", "leader") if done is None else done.union(compared.select("uid", "leader"))
        found.append(compared.where(F.col("similarity") >= similarity).select("uid", "leader"))
        if level == levels or starred.isEmpty():
            break
        rows = _finer(starred, reduce(DataFrame.union, found), reps, level, bands)
    return reduce(DataFrame.union, found), buckets, bodies, done


def links_of_classes(buckets: DataFrame, labels: DataFrame, bodies: DataFrame, done: DataFrame, similarity: float, k: int, idf) -> DataFrame:
    """(uid, leader) of the links, by label, between members of different classes in buckets that hold several.

    A stray is a member of another class than its bucket's leader.  Of any two
    members of different classes one is a stray, so only pairs with a stray are
    joined: members of one large class do not meet each other.
    """
    of = lambda c, name: labels.select(F.col("uid").alias(c), F.col("label").alias(name))
    placed = buckets.join(of("uid", "label"), "uid", "left").join(of("leader", "hub"), "leader", "left")
    placed = placed.select("set", "uid", F.coalesce("label", "uid").alias("label"), F.coalesce("hub", "leader").alias("hub"))
    placed = materialize(placed.withColumn("stray", F.col("label") != F.col("hub")), "placed")
    unsettled = placed.where("stray").select("set").distinct()
    members = placed.join(unsettled, "set", "left_semi").groupBy("uid").agg(F.max("label").alias("label"), F.max("stray").alias("stray"))
    texts = members.hint("merge").join(bodies, "uid").select("uid", "label", "stray", "body")
    tokens = materialize(texts.mapInArrow(_tokens(k, idf), _TOKENS), "tokens")
    prefixes = materialize(_prefixes(tokens, similarity), "prefixes")
    release(tokens)

    least = similarity * (1 - SLACK)
    needed = similarity / (1 + similarity) * (1 - SLACK) * (F.col("a.weight") + F.col("b.weight"))
    ordered = F.struct("a.weight", "a.uid") < F.struct("b.weight", "b.uid")
    near = (F.col("a.label") != F.col("b.label")) & ordered & (F.col("a.weight") >= least * F.col("b.weight")) & (F.least("a.rest", "b.rest") >= needed)
    near &= F.coalesce(F.col("a.before") != F.col("b.before"), F.lit(True))  # of shared shingles in a row, the first will do

    def met(small: DataFrame, large: DataFrame) -> DataFrame:
        both = small.where("small").alias("a").hint("merge").join(large.alias("b"), (F.col("a.token") == F.col("b.token")) & near)
        return both.select(F.col("a.uid").alias("uid"), F.col("b.uid").alias("leader"), F.col("a.label").alias("mine"), F.col("b.label").alias("theirs"))

    stray = F.col("stray")
    pairs = materialize(met(prefixes.where(stray), prefixes).union(met(prefixes.where(~stray), prefixes.where(stray))).distinct(), "pairs")
    seen = done.union(done.select("leader", "uid"))
    again = pairs.select("uid", "leader").join(seen, ["uid", "leader"], "left_anti")
    alike = _compared(again, bodies, k, idf).where(F.col("similarity") >= similarity).select("uid", "leader")
    return pairs.join(alike, ["uid", "leader"]).select(F.col("mine").alias("uid"), F.col("theirs").alias("leader")).distinct()


def components(links: DataFrame) -> DataFrame:
    """(uid, label): the least uid that links, in any direction, lead to.

    Every round a node takes the least label around it and then that label's own
    label, so a chain halves; each round is written, so none repeats the last.
    """
    ends = links.select(F.col("uid").alias("a"), F.col("leader").alias("b"))
    edges = materialize(ends.union(ends.select("b", "a")).distinct(), "edges")
    labels = materialize(edges.groupBy(F.col("a").alias("uid")).agg(F.least(F.min("b"), F.col("a")).alias("label")), "labels")
    while True:
        near = edges.join(labels, edges["b"] == labels["uid"]).groupBy(F.col("a").alias("uid")).agg(F.min("label").alias("near"))
        least = labels.join(near, "uid").select("uid", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("uid").alias("label"), F.col("label").alias("next"))
        stepped = least.join(jump, "label", "left").select("uid", "old", F.least("label", "next").alias("label"))
        new = materialize(stepped, "labels")
        changed = not new.where("label <> old").isEmpty()
        release(labels)
        labels = new.select("uid", "label")
        labels._scratch = new._scratch
        if not changed:
            return labels


def near_classes(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", similarity: float = SIMILARITY, words: int = WORDS,
    bands: int = BANDS, rows: int = ROWS, levels: int = LEVELS,
) -> DataFrame:
    """One row per input row: uid, doc_id, class_id, class_size, kept.

    Similarity is the weighted Jaccard of TF-IDF shingles of ``words`` words
    (blank-separated, as written); a text of fewer words is one shingle.  Equal
    word sequences are one class always, so all texts without words, null ones
    too, are one.  The class id is its smallest doc_id (null last); that row, the
    first of repeated ones, is kept.  An empty table gives an empty result.  Other
    columns are not read.  ``uid`` is the row's ``monotonically_increasing_id``.
    """
    sc = docs.sparkSession.sparkContext
    texts = docs.select(F.col(doc_id).cast("long").alias("doc_id"), utf8(text).alias("text"))
    idf = sc.broadcast(inverse_frequencies(texts.select("text"), words))
    sketched = materialize(texts.mapInArrow(_sketches(words, bands, rows, idf), _SKETCH), "sketches")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "uid", "keys")).alias("first")
    reps = sketched.groupBy("same").agg(first, F.count("*").alias("n"))
    reps = materialize(reps.select("same", "first.no_id", "first.doc_id", "first.uid", "first.keys", "n"), "distinct")

    links, *met = links_between(reps.where("keys is not null").select("uid", "keys"), sketched.select("uid", "body"), similarity, words, idf, levels, bands)
    labels = components(links)
    between = components(links_of_classes(met[0], labels, *met[1:], similarity, words, idf))
    labelled = reps.drop("keys").join(labels, "uid", "left").withColumn("label", F.coalesce("label", "uid"))
    between = between.select(F.col("uid").alias("label"), F.col("label").alias("joined"))
    labelled = labelled.join(between, "label", "left").withColumn("label", F.coalesce("joined", "label")).drop("joined")
    best = F.min(F.struct("no_id", "doc_id", "uid")).alias("best")
    classes = labelled.groupBy("label").agg(best, F.sum("n").alias("class_size"))
    by_text = materialize(labelled.join(classes, "label").select("same", "best", "class_size"), "classes")
    return sketched.select("uid", "doc_id", "same").join(by_text, "same").select(
        "uid",
        "doc_id",
        F.col("best.doc_id").alias("class_id"),
        "class_size",
        (F.col("uid") == F.col("best.uid")).alias("kept"),
    )


def drop_near_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **settings) -> DataFrame:
    """The one row of each class that is kept, with all its columns."""
    row = fresh(docs, "row_uid")
    kept = near_classes(docs, doc_id, text, **settings).where("kept").select(F.col("uid").alias(row))
    return docs.withColumn(row, F.monotonically_increasing_id()).join(kept, row, "left_semi").drop(row)
