"""Hard negatives by angular triangle filtering.

Every vector keeps its angles to a few reference directions, vectors of the table itself. Two
vectors' angle is at least the difference of their angles to a reference and at most their sum, so
the references give an interval for the cosine and, times both lengths, for the score; the interval is widened
by more than rounding can be off. A pair is scored, in whole numbers, only where its interval meets a window that is still open: while positives are
looked for, the scores from an anchor's fifth best so far; for negatives, the windows below its positives' scores.

Rows lie in tiles of one label, near each other in angle; anchors are the query set and lie in
tiles of their own. Narrow rows of tiles are paired first, and pairs whose intervals of angles rule
everything out are dropped; then the anchors' tiles travel to the rows' tiles. Each task keeps the best few of every
anchor it has seen, and only those leave it. How much the angles rule out depends on the data: directions without
clusters in many dimensions lie nearly at right angles to every reference, and most pairs are scored.

Cases: rows without a label, id or vector and rows with a null or non-finite component take no
part, nor do vectors longer than 2^20, whose scores have no place in a long; equal rows count once; a row
that shares the anchor's id is none of its positives; rows that share an id are else rows of their own; only
vectors of equal length are compared; an empty vector and a vector of zeros score 0 with all; an empty table gives an
empty result; other input columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talkframe.session import cut, runs_in_tasks

runs_in_tasks(__name__)

SCALE = 256
ANCHOR_EVERY = 100
RELABEL_EVERY = 7
LABELS = 10
POSITIVES = 5
NEGATIVES = 5
#: Negatives score between this many hundredths of the positive's score and all of it.
LEAST = 80
REFERENCES = 8
#: Vector lengths, the commonest first, that get references from the data; others use the axes.
LENGTHS = 16
TILE_ROWS = 8192
TILE_ANCHORS = 1024
#: Parts of the pairing of tiles, which has only a vector's length as its key.
SALTS = 64
#: More than angles of double precision can be off.
SLACK = 1e-6
LONGEST = 2.0**28


def usable(table: DataFrame) -> DataFrame:
    """(vec_id, label, q): whole-number vectors with their final labels, equal rows once."""
    vector = F.transform("embedding", lambda x: x.cast("double"))
    sound = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    short = F.aggregate(vector, F.lit(0.0), lambda t, x: t + x * x * (SCALE * SCALE)) < LONGEST**2
    rows = table.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull()).where(sound).where(short)
    label = F.col("label").cast("bigint")
    label = F.when(F.col("vec_id") % RELABEL_EVERY == 0, (label + 1) % LABELS).otherwise(label)
    return rows.select(F.col("vec_id").cast("bigint"), label.alias("label"), F.transform(vector, lambda x: F.floor(x * SCALE)).alias("q")).dropDuplicates()


def references(rows: DataFrame) -> dict[int, np.ndarray]:
    """Directions for the commonest vector lengths: the rows whose ids have the smallest hashes."""
    picks = [F.min_by("q", F.xxhash64("vec_id", F.lit(k))).alias(f"r{k}") for k in range(REFERENCES)]
    found = rows.groupBy(F.size("q").alias("d")).agg(F.count(F.lit(1)).alias("n"), *picks).orderBy(F.desc("n"), "d").limit(LENGTHS).collect()
    return {r["d"]: np.array([r[f"r{k}"] for k in range(REFERENCES)], float).reshape(REFERENCES, -1) for r in found}


def angles(q: np.ndarray, directions: np.ndarray) -> np.ndarray:
    """Angles of vectors to directions; a vector or direction of zeros is at right angles to all."""
    lengths = np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(directions, axis=1)[None]
    cosine = np.divide(q @ directions.T, lengths, out=np.zeros(lengths.shape), where=lengths > 0)
    return np.arccos(np.clip(cosine, -1, 1))


MEASURED = pa.schema([("vec_id", pa.int64()), ("label", pa.int64()), ("d", pa.int32()), ("q", pa.binary()), ("angles", pa.binary()), ("norm", pa.float64()), ("home", pa.int32()), ("angle", pa.float64())])
MEASURED_SQL = "vec_id bigint, label bigint, d int, q binary, angles binary, norm double, home int, angle double"


def measured(directions: dict[int, np.ndarray]) -> Callable:
    """Task function: vectors with their length, their angles, and the reference nearest to them."""

    def of(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        values = batch.column("q")
        sizes = values.value_lengths().to_numpy(zero_copy_only=False)
        ids, labels = batch.column("vec_id"), batch.column("label")
        for d in np.unique(sizes).tolist():
            at = np.flatnonzero(sizes == d)
            q = values.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(at), d)
            theirs = directions.get(d, np.eye(REFERENCES, d))
            theta = angles(q, theirs)
            home = theta.argmin(axis=1)
            columns = [ids.take(pa.array(at)), labels.take(pa.array(at)), pa.array([d] * len(at), pa.int32()), pa.array([x.tobytes() for x in q.astype("<i4")], pa.binary()), pa.array([x.tobytes() for x in theta], pa.binary())]
            columns += [pa.array(np.linalg.norm(q, axis=1)), pa.array(home.astype(np.int32)), pa.array(theta[np.arange(len(at)), home])]
            yield pa.RecordBatch.from_arrays(columns, schema=MEASURED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield from of(batch)

    return run


TILE = pa.schema([("label", pa.int64()), ("d", pa.int32()), ("ids", pa.binary()), ("q", pa.binary()), ("angles", pa.binary()), ("norms", pa.binary()), ("low", pa.list_(pa.float64())), ("high", pa.list_(pa.float64())), ("least", pa.float64()), ("most", pa.float64())])
TILE_SQL = "label bigint, d int, ids binary, q binary, angles binary, norms binary, low array<double>, high array<double>, least double, most double"


def packed(most: int) -> Callable:
    """Task function: sorted rows in tiles of one length and label and at most ``most`` rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d, label = batch.column("d").to_numpy(), batch.column("label").to_numpy()
            edges = np.flatnonzero((d[1:] != d[:-1]) | (label[1:] != label[:-1])) + 1
            for start, end in zip([0, *edges.tolist()], [*edges.tolist(), batch.num_rows]):
                for s in range(start, end, most):
                    part = batch.slice(s, min(most, end - s))
                    theta = b"".join(part.column("angles").to_pylist())
                    shaped, norms = np.frombuffer(theta).reshape(-1, REFERENCES), part.column("norm").to_numpy()
                    row = {"label": int(label[s]), "d": int(d[s]), "ids": part.column("vec_id").to_numpy().tobytes(), "q": b"".join(part.column("q").to_pylist()), "angles": theta, "norms": norms.tobytes()}
                    row |= {"low": shaped.min(axis=0).tolist(), "high": shaped.max(axis=0).tolist(), "least": float(norms.min()), "most": float(norms.max())}
                    yield pa.RecordBatch.from_pylist([row], TILE)

    return run


def tiles(rows: DataFrame, most: int) -> DataFrame:
    """Rows in tiles; ids are part of the order, so that equal vectors fall into several tiles."""
    by = ["d", "label", "home", "angle", "vec_id"]
    made = rows.repartitionByRange(*by).sortWithinPartitions(*by).mapInArrow(packed(most), TILE_SQL)
    return cut(made.withColumn("tile", F.monotonically_increasing_id()))


class Tile:
    def __init__(self, row: dict, mark: str = ""):
        read = lambda name, kind: np.frombuffer(row[mark + name], kind)
        self.ids, self.norms = read("ids", "<i8"), read("norms", "<f8")
        self.q = read("q", "<i4").reshape(len(self.ids), row["d"])
        self.angles = read("angles", "<f8").reshape(len(self.ids), REFERENCES)


def bounds(a: Tile, x: Tile, some: slice) -> tuple[np.ndarray, np.ndarray]:
    """Whole numbers between which the scores of ``a``'s rows ``some`` with all of ``x`` lie."""
    least = np.zeros((len(a.ids[some]), len(x.ids)))
    most = np.full(least.shape, np.pi)
    for k in range(REFERENCES):
        mine, theirs = a.angles[some, k][:, None], x.angles[:, k][None]
        both = mine + theirs
        np.maximum(least, np.abs(mine - theirs), out=least)
        np.minimum(most, np.minimum(both, 2 * np.pi - both), out=most)
    size = a.norms[some][:, None] * x.norms[None]
    spare = size * 1e-9 + SLACK
    high = np.cos(np.maximum(least - 2 * SLACK, 0)) * size + spare
    low = np.cos(np.minimum(most + 2 * SLACK, np.pi)) * size - spare
    return np.ceil(low), np.floor(high)


def scores(a: np.ndarray, x: np.ndarray, largest: float) -> np.ndarray:
    """Inner products of whole numbers, exact: in doubles while they hold every sum, else in longs."""
    if largest < 2.0**52:
        return (a.astype(np.float64) @ x.astype(np.float64).T).astype(np.int64)
    return a.astype(np.int64) @ x.astype(np.int64).T


def first(found: list[tuple[int, int]], more: Iterator[tuple[int, int]], most: int) -> list[tuple[int, int]]:
    """The best (score, id): higher scores, then smaller ids."""
    return sorted({*found, *more}, key=lambda f: (-f[0], f[1]))[:most]


def best_of(ids: np.ndarray, score: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    if len(score) > most:
        keep = score >= np.partition(score, len(score) - most)[len(score) - most]
        ids, score = ids[keep], score[keep]
        order = np.lexsort((ids, -score))[:most]
        ids, score = ids[order], score[order]
    return zip(score.tolist(), ids.tolist())


class Positives:
    """The best rows of the anchors' own label so far."""

    def __init__(self, row: dict, a: Tile):
        self.found: list[list[tuple[int, int]]] = [[] for _ in a.ids]

    def window(self, i: int) -> tuple[float, float]:
        held = self.found[i]
        return (held[-1][0] if len(held) == POSITIVES else -np.inf), np.inf

    def take(self, i: int, own: int, ids: np.ndarray, score: np.ndarray) -> None:
        other = ids != own
        self.found[i] = first(self.found[i], best_of(ids[other], score[other], POSITIVES), POSITIVES)

    def rows(self, anchor_tile: int) -> Iterator[tuple]:
        for i, held in enumerate(self.found):
            for score, vec_id in held:
                yield anchor_tile, i, 0, score, vec_id


class Negatives:
    """The best rows of other labels so far, for each positive of the anchors."""

    def __init__(self, row: dict, a: Tile):
        self.tops: list[list[tuple[int, int]]] = [[] for _ in a.ids]
        for p in row["positives"]:
            if p["score"] >= 0:
                self.tops[p["anchor"]].append((p["rank"], p["score"]))
        self.found = [{rank: [] for rank, _ in tops} for tops in self.tops]

    def _least(self, i: int, rank: int, top: int) -> int:
        held = self.found[i][rank]
        return held[-1][0] if len(held) == NEGATIVES else -(-LEAST * top // 100)

    def window(self, i: int) -> tuple[float, float]:
        if not self.tops[i]:
            return np.inf, -np.inf
        return min(self._least(i, *t) for t in self.tops[i]), max(top for _, top in self.tops[i])

    def take(self, i: int, own: int, ids: np.ndarray, score: np.ndarray) -> None:
        for rank, top in self.tops[i]:
            inside = (score <= top) & (score >= self._least(i, rank, top))
            self.found[i][rank] = first(self.found[i][rank], best_of(ids[inside], score[inside], NEGATIVES), NEGATIVES)

    def rows(self, anchor_tile: int) -> Iterator[tuple]:
        for i, each in enumerate(self.found):
            for rank, held in each.items():
                for score, vec_id in held:
                    yield anchor_tile, i, rank, score, vec_id


FOUND = pa.schema([("anchor_tile", pa.int64()), ("anchor", pa.int32()), ("rank", pa.int32()), ("score", pa.int64()), ("vec_id", pa.int64())])
FOUND_SQL = "anchor_tile bigint, anchor int, rank int, score bigint, vec_id bigint"
#: Anchor tiles whose best rows a task holds at once; the longest unused one leaves.
HELD = 256


def searched(kind: type) -> Callable:
    """Task function over pairs of tiles: what each anchor finds, once per task or whenever its tile leaves memory."""

    def meet(held: Positives | Negatives, a: Tile, x: Tile) -> None:
        for s in range(0, len(a.ids), 128):
            some = slice(s, s + 128)
            window = np.array([held.window(i) for i in range(s, min(s + 128, len(a.ids)))])
            low, high = bounds(a, x, some)
            meets = (high >= window[:, :1]) & (low <= window[:, 1:])
            mine, theirs = np.flatnonzero(meets.any(axis=1)), np.flatnonzero(meets.any(axis=0))
            if not len(mine):
                continue
            score = scores(a.q[some][mine], x.q[theirs], float(a.norms.max() * x.norms.max()))
            for k, i in enumerate(mine.tolist()):
                at = meets[i, theirs] & (score[k] >= window[i, 0]) & (score[k] <= window[i, 1])
                held.take(s + i, int(a.ids[s + i]), x.ids[theirs[at]], score[k][at])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        states: dict[int, Positives | Negatives] = {}

        def out(anchor_tile: int) -> Iterator[pa.RecordBatch]:
            rows = list(states.pop(anchor_tile).rows(anchor_tile))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), FOUND)], schema=FOUND)

        for batch in batches:
            for k in range(batch.num_rows):
                (row,) = batch.slice(k, 1).to_pylist()
                a, x, name = Tile(row, "a_"), Tile(row), row["anchor_tile"]
                state = states.pop(name, None) or kind(row, a)
                states[name] = state
                meet(state, a, x)
                if len(states) > HELD:
                    yield from out(next(iter(states)))
        for name in list(states):
            yield from out(name)

    return run


def anchor_columns(anchors: DataFrame) -> DataFrame:
    return anchors.select(F.col("tile").alias("anchor_tile"), *[F.col(c).alias(f"a_{c}") for c in ("label", "ids", "q", "angles", "norms", "low", "high", "least", "most")], F.col("d").alias("a_d"))


def narrow(df: DataFrame, blobs: tuple[str, ...]) -> DataFrame:
    return df.drop(*blobs)


def largest_score() -> Column:
    """Above every score of two tiles, by the gaps between their intervals of angles."""
    gaps = F.transform(F.sequence(F.lit(0), F.lit(REFERENCES - 1)), lambda k: F.greatest(F.get("low", k) - F.get("a_high", k), F.get("a_low", k) - F.get("high", k)))
    gap = F.greatest(F.array_max(gaps) - 4 * SLACK, F.lit(0.0))
    size = F.when(F.cos(gap) >= 0, F.col("most") * F.col("a_most")).otherwise(F.col("least") * F.col("a_least"))
    return F.cos(gap) * size + F.col("most") * F.col("a_most") * 1e-9 + SLACK


def meeting(rows: DataFrame, anchors: DataFrame, pairs: DataFrame) -> DataFrame:
    """Pairs of tiles with all they hold: the smaller, the anchors, are copied to the rows' tiles."""
    wide = pairs.select("tile", F.col("anchor_tile").alias("_a")).join(anchors, F.col("_a") == F.col("anchor_tile")).drop("_a")
    return wide.join(rows.select("tile", "d", "ids", "q", "angles", "norms"), "tile")


def top(found: DataFrame, most: int) -> DataFrame:
    """The best ``most`` of each anchor and rank over all tasks; equal finds count once. ``place`` counts from 1."""
    order = Window.partitionBy("anchor_tile", "anchor", "rank").orderBy(F.desc("score"), "vec_id")
    return found.distinct().withColumn("place", F.row_number().over(order)).where(F.col("place") <= most)


def hard_negatives(table: DataFrame, tile_rows: int = TILE_ROWS, tile_anchors: int = TILE_ANCHORS) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of all anchors and their positives."""
    vectors = usable(table)
    rows = cut(vectors.mapInArrow(measured(references(vectors)), MEASURED_SQL))
    all_rows = tiles(rows, tile_rows)
    queries = tiles(rows.where(F.col("vec_id") % ANCHOR_EVERY == 0), tile_anchors)
    anchors = anchor_columns(queries)
    small, asked = narrow(all_rows, ("ids", "q", "angles", "norms")), narrow(anchors, ("a_ids", "a_q", "a_angles", "a_norms"))

    own = small.join(asked, (F.col("d") == F.col("a_d")) & (F.col("label") == F.col("a_label")))
    positives = cut(top(meeting(all_rows, anchors, own).mapInArrow(searched(Positives), FOUND_SQL), POSITIVES))

    held = positives.groupBy("anchor_tile").agg(F.collect_list(F.struct("anchor", F.col("place").alias("rank"), "score")).alias("positives"), F.min("score").alias("worst"))
    others = small.withColumn("_salt", F.pmod("tile", F.lit(SALTS)))
    spread = asked.join(held.select("anchor_tile", "worst"), "anchor_tile").withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    pairs = others.join(spread, (F.col("d") == F.col("a_d")) & (F.col("_salt") == F.col("_s")) & (F.col("label") != F.col("a_label")))
    pairs = pairs.where(largest_score() >= F.greatest(F.col("worst"), F.lit(0)) * (LEAST / 100) - 1)
    with_windows = anchors.join(held.drop("worst"), "anchor_tile")
    negatives = top(meeting(all_rows, with_windows, pairs).mapInArrow(searched(Negatives), FOUND_SQL), NEGATIVES)

    names = queries.select(F.col("tile").alias("anchor_tile"), F.posexplode(ids_of("ids")).alias("anchor", "anchor_id"))
    told = positives.select(F.col("anchor_tile").alias("_t"), F.col("anchor").alias("_a"), F.col("place").alias("_r"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    done = negatives.join(told, (F.col("anchor_tile") == F.col("_t")) & (F.col("anchor") == F.col("_a")) & (F.col("rank") == F.col("_r")))
    done = done.join(names, ["anchor_tile", "anchor"])
    return done.select("anchor_id", "positive_id", F.col("place").alias("rank"), F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def ids_of(packed_ids: str) -> Column:
    """Little-endian longs of a binary."""

    @F.pandas_udf("array<bigint>")
    def read(values):
        return values.map(lambda v: np.frombuffer(v, "<i8"))

    return read(packed_ids)
