"""Mixtures of sources with target shares: raking, then calibrated sampling.

Documents are summed into cells of source, language and topic. On the cells iterative proportional
fitting rakes token weights to the three marginals, with the source shares last and every cell bounded
by its source's ``max_uses``. A document is then used the whole number of times of its cell's factor,
and once more if its hash falls below the cell's calibrated threshold.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass
from functools import cached_property, partial, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from filament.llm.tokens import TOKENIZER, encoder
from filament.runtime import durable

#: Thresholds are calibrated to 1 in so many hash bins of a cell.
BINS = 1024
#: Cells of up to this number are raked on the driver and broadcast; beyond it raking is a loop of aggregations.
DRIVER_CELLS = 200_000
#: Topics are so many clusters of all documents' words, in so many features.
TOPIC_FEATURES, TOPICS = 1024, 8
#: What so many tasks find of a topic model is merged on the driver; of more tasks first in one task.
MERGED_PARTS = 64
# Languages kept apart; others and unknown ones are one group each.
LANGUAGES = ("fr", "en", "de", "es", "it")


def language(lang: Column) -> Column:
    code = F.substring(F.lower(F.trim(lang)), 1, 2)
    return F.when(lang.isNull() | (F.lower(F.trim(lang)).isin("und", "")), "und").when(code.isin(*LANGUAGES), code).otherwise("other")


def bag(ids: list[int]) -> np.ndarray:
    """Token counts by feature."""
    return np.bincount(np.asarray(ids, np.int64) % TOPIC_FEATURES, minlength=TOPIC_FEATURES)


@dataclass
class Bags:
    """Token counts of texts that have tokens: ``sizes`` features each, with their ``counts``, one text after another."""

    features: np.ndarray
    counts: np.ndarray
    sizes: np.ndarray

    @cached_property
    def ends(self) -> np.ndarray:
        return self.sizes.cumsum()

    @cached_property
    def starts(self) -> np.ndarray:
        return self.ends - self.sizes

    @classmethod
    def of(cls, counts: np.ndarray) -> Bags:
        """From a matrix of counts, a row a text; rows of zeros are left out."""
        text, features = np.nonzero(counts)
        sizes = np.bincount(text, minlength=len(counts))
        return cls(features, counts[text, features], sizes[sizes > 0])

    @classmethod
    def read(cls, features: pa.Array, counts: pa.Array) -> Bags:
        """From the columns that ``measure`` writes, without empty rows."""
        sizes = pc.binary_length(features).to_numpy(zero_copy_only=False).astype(np.int64) // 2
        flat = (np.frombuffer(b"".join(x.to_pylist()), kind) for x, kind in ((features, "<u2"), (counts, "<u4")))
        return cls(next(flat).astype(np.intp), next(flat), sizes)


class TopicModel:
    """Spherical k-means over weighted token counts; texts without tokens have topic -1."""

    #: Coordinates are added up as whole numbers of 1 in so many, so that sums do not depend on the order of rows.
    GRAIN = 2.0**30

    def __init__(self, weight: np.ndarray, centres: np.ndarray):
        self.weight, self.centres = weight.astype(np.float32), centres.astype(np.float32)

    def unit(self, bags: Bags) -> np.ndarray:
        """The texts' coordinates as vectors of length 1, in the order of ``bags.features``."""
        x = np.log1p(bags.counts.astype(np.float32)) * self.weight[bags.features]
        return x / np.repeat(np.maximum(np.sqrt(np.add.reduceat(x * x, bags.starts)), np.float32(1e-12)), bags.sizes)

    def cosines(self, bags: Bags, x: np.ndarray) -> np.ndarray:
        """(centre, text)."""
        return np.stack([np.add.reduceat(x * c[bags.features], bags.starts) for c in self.centres])

    def topics(self, bags: Bags) -> np.ndarray:
        if not len(bags.sizes) or not len(self.centres):
            return np.full(len(bags.sizes), -1)
        return self.cosines(bags, self.unit(bags)).argmax(0)

    def topic(self, ids: list[int]) -> int:
        return int(self.topics(Bags.of(bag(ids)[None]))[0]) if len(ids) else -1

    def sums(self, bags: Bags) -> np.ndarray:
        """The sums of the texts nearest to each centre, in grains."""
        x = self.unit(bags)
        at = np.repeat(self.cosines(bags, x).argmax(0), bags.sizes) * TOPIC_FEATURES + bags.features
        return np.bincount(at, np.rint(x * self.GRAIN), len(self.centres) * TOPIC_FEATURES).astype(np.int64).reshape(-1, TOPIC_FEATURES)

    def farthest(self, bags: Bags, sign: int = 1) -> tuple[float, bytes, bytes]:
        """The text farthest from its nearest centre (``sign`` -1: nearest), its features and counts; of equals the least."""
        near = sign * self.cosines(bags, self.unit(bags)).max(0).round(6)
        part = lambda a, i, kind: a[bags.starts[i] : bags.ends[i]].astype(kind).tobytes()
        return min((float(near[i]), part(bags.features, i, "<u2"), part(bags.counts, i, "<u4")) for i in np.flatnonzero(near == near.min()))

    @classmethod
    def fit(cls, counts: np.ndarray, topics: int = TOPICS, rounds: int = 30) -> TopicModel:
        """From counts in memory, a row a text."""
        bags = Bags.of(counts)
        return cls.fit_over(len(counts), lambda step, merge: step(bags) if len(bags.sizes) else None, topics, rounds)

    @classmethod
    def fit_over(cls, n: int, each: Callable, topics: int = TOPICS, rounds: int = 30) -> TopicModel:
        """From all of ``n`` texts; starts with the texts farthest from those chosen before. Deterministic.

        ``each(step, merge)`` applies ``step`` to all bags and merges what it gives two by two; it gives
        None if there is no text with tokens.
        """
        model = cls(np.zeros(TOPIC_FEATURES), np.zeros((0, TOPIC_FEATURES)))
        used = each(_used, np.add)
        if used is None:
            return model
        model.weight = np.log((1 + n) / (1 + used)).astype(np.float32)

        def means(centres: np.ndarray) -> np.ndarray:
            got = each(cls(model.weight, centres).sums, np.add).astype(float)
            length = np.linalg.norm(got, axis=1, keepdims=True)
            return np.where(length > 0, got / np.maximum(length, 1e-12), centres)

        _, *first = each(partial(cls(model.weight, means(np.zeros((1, TOPIC_FEATURES)))).farthest, sign=-1), min)
        chosen, centres = [], np.zeros((0, TOPIC_FEATURES))
        text, near = first, 0.0
        # Where all texts are like the chosen ones, more centres would be copies.
        while text not in chosen and near < 1 - 1e-6:
            chosen.append(text)
            b = Bags.read(pa.array(text[:1]), pa.array(text[1:]))
            centre = np.zeros((1, TOPIC_FEATURES))
            centre[0, b.features] = model.unit(b)
            centres = np.concatenate([centres, centre])
            if len(chosen) == topics:
                break
            near, *text = each(cls(model.weight, centres).farthest, min)
        for _ in range(rounds):
            new = means(centres)
            if np.allclose(new, centres, atol=1e-6):
                break
            centres = new
        return cls(model.weight, centres)


def _used(bags: Bags) -> np.ndarray:
    """How many texts have each feature."""
    return np.bincount(bags.features, minlength=TOPIC_FEATURES)


def fit_topics(bags: DataFrame) -> TopicModel:
    """A topic model of all rows of ``bags`` (features, counts), each of which is read in every pass."""

    def each(step: Callable, merge: Callable) -> object:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            # Few texts at a time, so that their coordinates stay in a processor's cache.
            parts = (step(Bags.read(*b.slice(i, 250).columns)) for b in batches for i in range(0, b.num_rows, 250))
            yield from whole(parts)

        def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            yield from whole(pickle.loads(x) for b in batches for x in b.column(0).to_pylist())

        def whole(parts: Iterator) -> Iterator[pa.RecordBatch]:
            if (first := next(parts, None)) is not None:
                yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(reduce(merge, parts, first))], pa.binary())], names=["part"])

        got = full.mapInArrow(run, "part binary")
        if many:
            got = got.repartition(1).mapInArrow(join, "part binary")
        parts = [pickle.loads(r[0]) for r in got.collect()]  # at most MERGED_PARTS rows of some 64 KB
        return reduce(merge, parts) if parts else None

    full = bags.select("features", "counts").where("length(features) > 0")
    many = full.rdd.getNumPartitions() > MERGED_PARTS
    return TopicModel.fit_over(bags.count(), each)


def measure(documents: DataFrame, columns: str, tokenizer: str = TOKENIZER, words: bool = True) -> DataFrame:
    """The first columns of ``documents``, whose last is the text, with ``tokens`` in its place, and with ``words`` the text's ``features`` and their ``counts``."""
    names = ["tokens", *(["features", "counts"] if words else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, _ = encoder(tokenizer)
        for b in batches:
            sizes, features, counts = [], [], []
            for text in b.column(b.num_columns - 1):  # one text at a time, so that only its tokens are held
                ids = enc.encode_ordinary(text.as_py() or "")
                sizes.append(len(ids))
                if words:
                    full = bag(ids)
                    has = np.flatnonzero(full)
                    features.append(has.astype("<u2").tobytes())
                    counts.append(full[has].astype("<u4").tobytes())
            more = [pa.array(sizes, pa.int64()), *((pa.array(x, pa.binary()) for x in (features, counts)) if words else [])]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *more], names=[*b.schema.names[:-1], *names])

    return documents.mapInArrow(run, f"{columns}, tokens bigint{', features binary, counts binary' if words else ''}")


def assign(bags: DataFrame, model: TopicModel) -> DataFrame:
    """``bags`` with the ``topic`` of each text in place of its last two columns, features and counts."""
    columns = bags.columns[:-2]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (b.slice(i, 250) for b in batches for i in range(0, b.num_rows, 250)):
            texts = Bags.read(*b.columns[-2:])
            topics = np.full(b.num_rows, -1)
            topics[texts.sizes > 0] = model.topics(Bags(texts.features, texts.counts, texts.sizes[texts.sizes > 0]))
            yield pa.RecordBatch.from_arrays([*b.columns[:-2], pa.array(topics.astype(str), pa.string())], names=[*columns, "topic"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in bags.schema.fields[:-2])
    return bags.mapInArrow(run, f"{kinds}, topic string")


@dataclass
class Mixture:
    """``uses``: (doc_id, source, tokens, uses) of the documents used; ``report``: one row a source."""

    uses: DataFrame
    report: DataFrame


def rake(tokens: np.ndarray, cell_of: list[np.ndarray], targets: list[np.ndarray], cap: np.ndarray, rounds: int = 200) -> np.ndarray:
    """Cell masses whose marginals approach ``targets``; the last margin holds unless caps forbid it."""
    mass = np.minimum(tokens.astype(float), cap)
    for _ in range(rounds):
        start = mass.copy()
        for at, want in zip(cell_of, targets, strict=True):
            have = np.bincount(at, mass, len(want))
            mass = np.minimum(mass * np.divide(want, have, out=np.ones_like(want), where=have > 0)[at], cap)
        if np.allclose(start, mass, rtol=1e-10, atol=1e-6):
            break
    at, want = cell_of[-1], targets[-1]
    for _ in range(len(mass) + 1):
        # Mass that a full cell could not take goes to the cells of its group that have room.
        free = mass < cap * (1 - 1e-12)
        have, loose = np.bincount(at, mass, len(want)), np.bincount(at, mass * free, len(want))
        gap = want - have
        grow = np.divide(gap, loose, out=np.zeros_like(want), where=loose > 0)
        if not (np.abs(grow * loose) > 1e-6 * np.maximum(want, 1)).any():
            break
        mass = np.minimum(np.where(free, mass * np.maximum(0, 1 + grow[at]), mass), cap)
    return mass


def rake_frame(cells: DataFrame, targets: Mapping[str, DataFrame], rounds: int = 30) -> DataFrame:
    """(source, lang, topic, factor): the same on a table of cells (.., tokens, max_uses), of any number.

    ``targets`` has a table (name, want) for every margin, the source last. Each round is an aggregation
    and a join a margin, written to the shared folder; it ends when no mass moves by more than 1 in a million.
    """
    now = durable(cells.withColumn("cap", F.col("max_uses") * F.col("tokens").cast("double")).withColumn("mass", F.least(F.col("tokens").cast("double"), "cap")), "rake")
    for _ in range(rounds):
        step = now.withColumn("before", F.col("mass"))
        for name, want in targets.items():
            have = step.groupBy(name).agg(F.sum("mass").alias("have")).join(want, name, "left")
            pull = F.when(F.col("have") > 0, F.coalesce("want", F.lit(0.0)) / F.col("have")).otherwise(1.0)
            step = step.join(have.select(name, pull.alias("pull")), name).withColumn("mass", F.least(F.col("mass") * F.col("pull"), "cap")).drop("pull")
        step = durable(step, "rake")
        moved = step.agg(F.max(F.abs(F.col("mass") - F.col("before")) / F.greatest("before", F.lit(1.0)))).collect()[0][0] or 0.0
        now = step.drop("before")
        if moved < 1e-6:
            break
    *_, (name, want) = targets.items()
    for _ in range(rounds):
        free = F.col("mass") < F.col("cap") * (1 - 1e-12)
        room = now.groupBy(name).agg(F.sum("mass").alias("have"), F.coalesce(F.sum(F.when(free, F.col("mass"))), F.lit(0.0)).alias("loose")).join(want, name)
        grow = F.when(F.col("loose") > 0, (F.col("want") - F.col("have")) / F.col("loose")).otherwise(0.0)
        room = durable(room.select(name, grow.alias("grow"), F.abs(grow * F.col("loose")).alias("left"), "want"), "rake")
        if not room.where("left > 1e-6 * greatest(want, 1)").take(1):
            break
        now = durable(now.join(room.select(name, "grow"), name).withColumn("mass", F.least(F.when(free, F.col("mass") * F.greatest(F.lit(0.0), 1 + F.col("grow"))).otherwise(F.col("mass")), "cap")).drop("grow"), "rake")
    return now.select("source", "lang", "topic", F.coalesce(F.col("mass") / F.nullif("tokens", F.lit(0)), F.lit(0.0)).alias("factor"))


def mix(documents: DataFrame, targets: DataFrame, seed: int = 0, tokenizer: str = TOKENIZER, lang_shares: Mapping[str, float] | None = None, topic_shares: Mapping[str, float] | None = None, topic: str | None = None, driver_cells: int = DRIVER_CELLS) -> Mixture:
    """Mixes ``documents`` (doc_id, text, lang, source) to ``targets`` (source, target_share, max_uses).

    The mixture is as large as all documents of the sources that have a target. A source that cannot
    reach its share within ``max_uses`` is used in full, and the report says so; the shares really
    reached are of the mixture as it came out. Language and topic approach ``lang_shares`` and
    ``topic_shares`` (name to share; missing names get none), or where these are not given the shares
    they have among the documents, as far as the source shares and the caps allow. The topic is the
    column named by ``topic``, or a cluster of a model fitted on all documents used (``fit_topics``).

    Rows with a null source or one without a target are not used. All rows count as they stand:
    repeated documents are each used. Null texts have no tokens, null topics are "other". Null or
    negative shares and caps count as 0. A source with several target rows takes the largest share and
    cap. Empty documents or targets give an empty mixture.
    """
    spark = documents.sparkSession
    wanted = targets.where("source is not null").groupBy("source").agg(F.max(F.greatest(F.coalesce("target_share", F.lit(0.0)), F.lit(0.0))).alias("target_share"), F.max(F.greatest(F.coalesce("max_uses", F.lit(0)), F.lit(0))).alias("max_uses"))
    wanted = durable(wanted, "targets")
    few = F.broadcast if wanted.count() <= driver_cells else lambda x: x
    u = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(BINS)).cast("int")
    named = documents.join(few(wanted.select("source")), "source")
    kinds = f"doc_id {documents.schema['doc_id'].dataType.simpleString()}, source string, lang string, bin int"
    given = [] if topic is None else [F.coalesce(F.col(f"`{topic}`").cast("string"), F.lit("other")).alias("topic")]
    named = named.select("doc_id", F.col("source").cast("string").alias("source"), language(F.col("lang")).alias("lang"), u.alias("bin"), *given, F.col("text").cast("string").alias("text"))
    if given:
        docs = durable(measure(named, kinds + ", topic string", tokenizer, False), "mix")
    else:
        bags = durable(measure(named, kinds, tokenizer), "bags")
        docs = durable(assign(bags, fit_topics(bags)), "mix")
    cells = durable(docs.groupBy("source", "lang", "topic").agg(F.sum("tokens").alias("tokens")).join(few(wanted), "source"), "cells")
    size = cells.agg(F.count(F.lit(1)), F.sum("tokens")).collect()[0]
    total = float(size[1] or 0)
    shares = {"lang": lang_shares, "topic": topic_shares}
    if size[0] <= driver_cells:
        rows = cells.collect()
        factor = F.broadcast(spark.createDataFrame(_factors(rows, total, shares), "source string, lang string, topic string, factor double"))
    else:
        margins = {}
        for name, want in shares.items():
            own = cells.groupBy(name).agg(F.sum("tokens").cast("double").alias("want"))
            margins[name] = own if want is None else spark.createDataFrame([(k, float(v) * total) for k, v in want.items()], f"{name} string, want double")
        margins["source"] = wanted.select("source", (F.col("target_share") * total).alias("want"))
        factor = rake_frame(cells, margins)
    # The threshold of a cell: the most whole bins whose tokens fit the fraction that is left.
    bins = docs.groupBy("source", "lang", "topic", "bin").agg(F.sum("tokens").alias("tokens")).join(factor, ["source", "lang", "topic"])
    w = Window.partitionBy("source", "lang", "topic")  # at most BINS rows
    part = F.col("factor") - F.floor("factor")
    below = F.sum("tokens").over(w.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)) - F.col("tokens") / 2
    chosen = bins.withColumn("take", below <= part * F.sum("tokens").over(w)).where("factor > 0").select("source", "lang", "topic", "bin", (F.floor("factor") + F.when(F.col("take") & (part > 0), 1).otherwise(0)).cast("int").alias("uses"))
    # One row a cell and bin: each document takes the uses of its own.
    few_bins = F.broadcast if size[0] * BINS <= driver_cells * 5 else lambda x: x
    used = docs.join(few_bins(chosen.where("uses > 0")), ["source", "lang", "topic", "bin"]).select("doc_id", "source", "tokens", "uses")
    # What the sources have and what was drawn of them, from the same cells and bins as the documents drawn.
    have = docs.groupBy("source", "lang", "topic", "bin").agg(F.sum("tokens").alias("tokens"))
    got = have.join(chosen, ["source", "lang", "topic", "bin"], "left").groupBy("source").agg(F.sum("tokens").alias("tokens"), F.sum(F.col("tokens") * F.coalesce("uses", F.lit(0))).alias("used_tokens"))
    report = wanted.join(got, "source", "left").na.fill(0, ["tokens", "used_tokens"])
    report = report.withColumn("reached_share", F.col("used_tokens") / F.nullif(F.sum("used_tokens").over(Window.partitionBy()), F.lit(0)))
    # A source cannot reach its share if all of it was drawn as often as may be and that is too little.
    full = F.col("used_tokens") >= F.col("max_uses") * F.col("tokens")
    report = report.withColumn("feasible", ~(full & (F.col("used_tokens") < F.col("target_share") * F.lit(total))))
    return Mixture(used, report)


def _factors(cells: list, total: float, shares: Mapping[str, Mapping[str, float] | None]) -> list[tuple]:
    """(source, lang, topic, factor) of collected cells."""
    if total <= 0:
        return []
    tokens = np.array([float(c["tokens"]) for c in cells])
    at, want = [], []
    for dim in ("lang", "topic", "source"):
        place: dict[str, int] = {}
        index = np.array([place.setdefault(c[dim], len(place)) for c in cells])
        at.append(index)
        if dim == "source":
            share = {c["source"]: c["target_share"] for c in cells}
            want.append(np.array([share[n] * total for n in place]))
        elif shares[dim] is None:
            want.append(np.bincount(index, tokens, len(place)))
        else:
            want.append(np.array([float(shares[dim].get(n, 0.0)) * total for n in place]))
    cap = np.array([c["max_uses"] * float(c["tokens"]) for c in cells])
    mass = rake(tokens, at, want, cap)
    return [(c["source"], c["lang"], c["topic"], float(m / t) if t else 0.0) for c, m, t in zip(cells, mass, tokens, strict=True)]
