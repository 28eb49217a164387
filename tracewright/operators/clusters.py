"""Statistics of a backtest's groups from rows that are dealt before they multiply.

A pattern's groups at several levels, intents, regimes and horizons are all made of the same episodes. These are brought to one task once (for the level of wallets, the wallet's episodes), and multiply there, in
Arrow batches of whole clusters: the rows of one scope, entity, asset and pattern. Names stay beside the rows and need no codes. Clusters of more than CLUSTER rows are left to `backtest.levels`.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.operators.stats import intervals
from tracewright.sources.shared import spread

#: Rows of a cluster up to which a task holds it whole, and rows that are measured together.
CLUSTER, TOGETHER = 1_000_000, 100_000
#: What an item counts for: kinds from and to, its level, and whether groups are told by intent and by regime. ACTION patterns (kind 2) count for level 2 only under a regime, the first token (0) for levels 0 and 1.
ENTITY = ((0, 0, 0, False, False), (0, 0, 1, True, False), (1, 1, 2, False, False), (1, 2, 3, True, False), (1, 2, 2, False, True), (1, 2, 3, True, True))
WALLET = ((1, 2, 4, True, False), (1, 2, 4, True, True))
KEYS = "_level int, scope_id string, entity_id string, pattern string, intent_label string, asset_key string, horizon_seconds int"
SUMMARY = ["mean_return", "median_return", "std_return"]
HOLDOUT = ["train_mean", "test_mean_return", "holdout_accuracy"]
_ROW = ["episode_id", "start_ts", "entity_id", "asset_key", "intent_label", "regime", "returns"]


def _kinds(p) -> F.Column:
    return F.struct(F.when(p.startswith("ACTION:"), 2).otherwise(1).alias("kind"), p.alias("pattern"))


def _own() -> F.Column:
    return F.transform(F.array_compact(F.array_distinct(F.coalesce("patterns", F.array().cast("array<string>")))), _kinds)


def entity_items(obs: DataFrame) -> DataFrame:
    """Nested observations once for their first token and for each of their patterns."""
    first = F.struct(F.lit(0).alias("kind"), F.split_part("motif", F.lit(">"), F.lit(1)).alias("pattern"))
    return obs.select(*_ROW, F.col("entity_id").alias("scope_id"), F.inline(F.concat(F.array(first), _own())))


def wallet_rows(obs: DataFrame) -> DataFrame:
    return obs.select(*_ROW, "patterns", F.explode(F.array_distinct("wallets")).alias("scope_id"))


def wallet_items(rows: DataFrame) -> DataFrame:
    return rows.select(*_ROW, "scope_id", F.inline(_own()))


def fit(obs: DataFrame, by_asset: bool = True) -> bool:
    """Whether no cluster has more than CLUSTER rows."""
    if obs.count() <= CLUSTER:
        return True
    asset = ["asset_key"] * by_asset
    counted = (df.groupBy(*keys, *asset).count().agg(F.max("count")).first()[0] or 0 for df, keys in ((entity_items(obs), ["scope_id", "kind", "pattern"]), (wallet_rows(obs), ["scope_id"])))
    return all(most <= CLUSTER for most in counted)


def _codes(table: pa.Table, name: str) -> tuple[np.ndarray, int]:
    column = table[name].combine_chunks()
    if pa.types.is_integer(column.type):
        return column.to_numpy(), 0
    coded = column.dictionary_encode(null_encoding="encode")
    return coded.indices.to_numpy(), len(coded.dictionary)


def _boundaries(table: pa.Table, names: list[str]) -> np.ndarray:
    """Whether a row begins a cluster."""
    new = np.zeros(table.num_rows, bool)
    new[0] = True
    for name in names:
        code, _ = _codes(table, name)
        new[1:] |= code[1:] != code[:-1]
    return new


def _whole(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[pa.Table]:
    """Tables of whole clusters, of TOGETHER rows or more; the batches are sorted by cluster."""
    held, limit = [], TOGETHER
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) < limit:
            continue
        table = pa.Table.from_batches(held)
        last = int(np.flatnonzero(_boundaries(table, names))[-1])
        if last:
            yield table.slice(0, last)
            held, limit = table.slice(last).combine_chunks().to_batches(), TOGETHER
            limit += sum(b.num_rows for b in held)
        else:
            limit *= 2
    if held and (table := pa.Table.from_batches(held)).num_rows:
        yield table


def _variants(table: pa.Table, clusters: list[str], variants: tuple) -> Iterator[tuple[int, bool, bool, int, np.ndarray, np.ndarray, np.ndarray]]:
    """For each variant and horizon: level, whether intent and regime tell groups, horizon, numbers of groups, rows (in order within a group) and their returns."""
    cluster = np.cumsum(_boundaries(table, clusters)) - 1
    (intent, intents), (regime, regimes), (kind, _) = _codes(table, "intent_label"), _codes(table, "regime"), _codes(table, "kind")
    known = pc.fill_null(pc.not_equal(table["regime"], "unknown"), False).combine_chunks().to_numpy(zero_copy_only=False)
    lists = table["returns"].combine_chunks()
    flat, row = lists.flatten(), np.repeat(np.arange(table.num_rows), lists.value_lengths().to_numpy())
    horizons, values = flat.field(0).to_numpy(), flat.field(1).to_numpy(zero_copy_only=False)
    for low, high, level, by_intent, by_regime in variants:
        held = (kind >= low) & (kind <= high) & (known if by_regime else True)
        group = cluster.astype(np.int64)
        if by_intent:
            group = group * intents + intent
        if by_regime:
            group = group * regimes + regime
        mine = held[row]
        for horizon in np.unique(horizons[mine]):
            at = np.flatnonzero(mine & (horizons == horizon))
            numbers = group[row[at]]
            order = np.argsort(numbers, kind="stable")
            yield level, by_intent, by_regime, int(horizon), numbers[order], row[at][order], values[at][order]


def _named(table: pa.Table, level: int, by_intent: bool, by_regime: bool, horizon: int, rows: np.ndarray) -> list[pa.Array]:
    """The columns of KEYS of groups that have these rows."""
    one = {c: table[c].combine_chunks().take(pa.array(rows)) for c in ("scope_id", "entity_id", "pattern", "intent_label", "asset_key", "regime")}
    pattern = pc.binary_join_element_wise(pc.binary_join_element_wise("REGIME:", one["regime"], ""), one["pattern"], "|") if by_regime else one["pattern"]
    intent = one["intent_label"] if by_intent else pa.array([""] * len(rows), pa.string())
    return [pa.array(np.full(len(rows), level, np.int32)), one["scope_id"], one["entity_id"], pattern, intent, one["asset_key"], pa.array(np.full(len(rows), horizon, np.int32))]


def _statistics(min_n: int, summary: bool, samples: int, seed: int, share: float, clusters: list[str], variants: tuple) -> tuple[Callable, str]:
    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole(batches, clusters):
            for *which, numbers, rows, v in _variants(table, clusters, variants):
                starts = np.flatnonzero(np.concatenate([[True], numbers[1:] != numbers[:-1]]))
                n = np.diff(np.append(starts, len(numbers)))
                if min_n > 1:
                    kept = np.repeat(n >= min_n, n)
                    rows, v, n = rows[kept], v[kept], n[n >= min_n]
                    starts = np.cumsum(n) - n
                if not len(n):
                    continue
                of = np.repeat(np.arange(len(n)), n)
                total = lambda x: np.add.reduceat(x, starts)  # noqa: B023, E731
                cut = np.maximum(1, np.floor(n * share + 1e-9)).astype(np.int64)
                train = np.arange(len(v)) - starts[of] < cut[of]
                rest = n - cut
                first = total(np.where(train, v, 0.0)) / cut
                with np.errstate(invalid="ignore", divide="ignore"):
                    test = total(np.where(train, 0.0, v)) / rest
                    right = np.where(first < 0, total((~train & (v < 0)).astype(np.int64)), total((~train & (v > 0)).astype(np.int64))) / rest
                none = rest == 0
                columns = [n, cut, rest, first, pa.array(test, mask=none), pa.array(right, mask=none)]
                if summary:
                    mean = total(v) / n
                    std = np.sqrt(total((v - mean[of]) ** 2) / np.maximum(n - 1, 1))
                    ranked = v[np.lexsort((v, of))]
                    columns += [mean, (ranked[starts + (n - 1) // 2] + ranked[starts + n // 2]) / 2, std, total((v < 0).astype(np.int64)), total((v > 0).astype(np.int64))]
                if samples:
                    low, high = np.empty(len(n)), np.empty(len(n))
                    for size in np.unique(n):
                        own = np.flatnonzero(n == size)
                        for part in np.array_split(own, max(1, len(own) * int(size) // 1_000_000)):
                            low[part], high[part] = intervals(ranked[starts[part][:, None] + np.arange(size)], samples, seed)
                    columns += [low, high]
                yield pa.RecordBatch.from_arrays([*_named(table, *which, rows[starts]), *[c if isinstance(c, pa.Array) else pa.array(c) for c in columns]], names=names)

    fields = [KEYS, "n long, train_n long, test_n long", *[f"{c} double" for c in HOLDOUT]]
    fields += [f"{c} double" for c in SUMMARY] * summary + ["negative_count long, positive_count long"] * summary + ["ci_low double, ci_high double"] * bool(samples)
    schema = ", ".join(fields)
    names = [f.split()[0] for f in schema.split(", ")]
    return measure, schema


def statistics(obs: DataFrame, min_n: int = 1, summary: bool = True, samples: int = 0, seed: int = 42, share: float = 0.7) -> DataFrame:
    """KEYS, n and hold-outs of all groups at all levels with at least min_n observations; with summary, mean_return, median_return, std_return and counts of signs; with samples (and summary), intervals too.

    obs is what backtest.nested() returns, stored. Patterns do not begin with REGIME: themselves.
    """
    clusters = ["scope_id", "entity_id", "asset_key", "kind", "pattern"]
    taken = [*clusters, "intent_label", "regime", "returns"]
    of_entities = spread(entity_items(obs), "entity_id", "asset_key", "pattern")
    of_wallets = wallet_items(spread(wallet_rows(obs), "scope_id", "asset_key"))
    found = []
    for items, variants in ((of_entities, ENTITY), (of_wallets, WALLET)):
        measure, schema = _statistics(min_n, summary, samples, seed, share, clusters, variants)
        found.append(items.sortWithinPartitions(*clusters, "start_ts", "episode_id").select(*taken).mapInArrow(measure, schema))
    return found[0].unionByName(found[1])


def mixed_assets(obs: DataFrame) -> DataFrame:
    """_level, scope_id, pattern, intent_label, horizon_seconds, assets: groups that would mix assets, and how many. obs as for statistics()."""
    clusters = ["scope_id", "kind", "pattern"]

    def count(variants: tuple) -> Callable:
        def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for table in _whole(batches, clusters):
                asset, assets = _codes(table, "asset_key")
                for *which, numbers, rows, _ in _variants(table, clusters, variants):
                    pairs, at = np.unique(numbers * assets + asset[rows], return_index=True)
                    _, first, times = np.unique(pairs // assets, return_index=True, return_counts=True)
                    several = times > 1
                    level, scope, _, pattern, intent, _, horizon = _named(table, *which, rows[at[first[several]]])
                    yield pa.RecordBatch.from_arrays([level, scope, pattern, intent, horizon, pa.array(times[several])], names=["_level", "scope_id", "pattern", "intent_label", "horizon_seconds", "assets"])

        return measure

    # The horizons are all that is asked for, so returns are left behind before rows are dealt.
    bare = obs.withColumn("returns", F.transform("returns", lambda x: F.struct(x["horizon_seconds"].alias("horizon_seconds"), F.lit(0.0).alias("simple_return"))))
    taken = [*clusters, "entity_id", "asset_key", "intent_label", "regime", "returns"]
    schema = "_level int, scope_id string, pattern string, intent_label string, horizon_seconds int, assets long"
    of_entities, of_wallets = spread(entity_items(bare).drop("episode_id", "start_ts"), "entity_id", "pattern"), spread(wallet_rows(bare), "scope_id")
    return of_entities.sortWithinPartitions(*clusters).select(*taken).mapInArrow(count(ENTITY), schema).unionByName(wallet_items(of_wallets).sortWithinPartitions(*clusters).select(*taken).mapInArrow(count(WALLET), schema))
