"""A training mixture with target weights per source.

Token weights of the cells (source, language, topic) are raked by iterative proportional fitting: the source marginal is
the wanted one, the language and topic marginals are those of the corpus. Rows are then drawn by their calibrated weight.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feuillet.plans.shared import write_shared

DRIVER_CELLS = 4_000_000  # up to so many cells are fitted on the driver (20 bytes each), more where they lie, by the same steps
Sums = Callable[[np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]]


def clean_source(c: Column) -> Column:
    """Trimmed, lower-case name of a source; blank becomes null."""
    name = F.lower(F.regexp_replace(c, r"(?U)^\s+|\s+$", ""))
    return F.when(name != "", name)


def byte_tokens(c: Column) -> Column:
    """Tokens of the public byte tokenizer without end marks: one per UTF-8 byte, 0 for null."""
    return F.coalesce(F.octet_length(c), F.lit(0)).cast("long")


def _prepared(df: DataFrame, text_col: str, source_col: str, lang_col: str, topic_col: str, id_col: str | None = None) -> DataFrame:
    own = [df[id_col].alias("row_id")] if id_col else []
    level = lambda c: F.coalesce(F.lower(F.trim(c.cast("string"))), F.lit(""))
    return df.select(*own, clean_source(df[source_col]).alias("source"), level(df[lang_col]).alias("lang"), level(df[topic_col]).alias("topic"), byte_tokens(df[text_col]).alias("tokens"))


def cell_weights(a: np.ndarray, b: np.ndarray, c: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Copies of cells, from the factors of their source, language and topic: never more than the source allows."""
    return np.minimum(most, a * b * c)


def fit_factors(sums: Sums, goal: np.ndarray, room: np.ndarray, langs: np.ndarray, topics: np.ndarray, rounds: int = 60) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Factors of sources, languages and topics by iterative proportional fitting. `sums` gives the weighted tokens of each
    source, language and topic under given factors; `goal` is what each source should have, `room` what it has at most,
    `langs` and `topics` are their natural tokens. The source marginal is fitted last, so it holds; the others come as near
    to their natural shares as that leaves room for."""
    a, b, c = np.ones(len(goal)), np.ones(len(langs)), np.ones(len(topics))
    if not goal.sum():
        return a * 0, b, c
    full = goal >= room  # every cell at its most
    a[full] = 1e12
    part = lambda natural: natural / natural.sum() * goal.sum()

    def fit_sources(times: int) -> None:
        for _ in range(times):
            now = sums(a, b, c)[0]
            a[~full] *= (goal / np.maximum(now, 1e-9))[~full]
            if np.all(np.abs(now - goal)[~full] <= 1e-9 * np.maximum(goal[~full], 1)):
                return

    for _ in range(rounds):
        before = np.concatenate([a[~full], b, c])
        b *= np.clip(part(langs) / np.maximum(sums(a, b, c)[1], 1e-9), 1e-3, 1e3)
        c *= np.clip(part(topics) / np.maximum(sums(a, b, c)[2], 1e-9), 1e-3, 1e3)
        fit_sources(1)
        if np.max(np.abs(np.concatenate([a[~full], b, c]) / np.maximum(before, 1e-300) - 1)) < 1e-6:
            break
    fit_sources(200)
    return a, b, c


def local_sums(tokens: np.ndarray, source: np.ndarray, lang: np.ndarray, topic: np.ndarray, most: np.ndarray, n_langs: int, n_topics: int) -> Sums:
    def sums(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        own = tokens * cell_weights(a[source], b[lang], c[topic], most[source])
        return np.bincount(source, own, len(most)), np.bincount(lang, own, n_langs), np.bincount(topic, own, n_topics)

    return sums


def spread_sums(coded: DataFrame, most: np.ndarray, n_langs: int, n_topics: int) -> Sums:
    """The same over a table of cells (source, lang, topic as numbers, tokens): each task adds up its own, one job a call."""
    spark = coded.sparkSession
    sizes = (len(most), n_langs, n_topics)

    def sums(*factors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        known = spark.sparkContext.broadcast((*factors, most))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = [np.zeros(n) for n in sizes]
            for batch in batches:
                s, lang, topic, tokens = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
                for k, part in enumerate(local_sums(tokens, s, lang, topic, known.value[3], n_langs, n_topics)(*known.value[:3])):
                    total[k] += part
            for axis, t in enumerate(total):
                some = np.nonzero(t)[0]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), axis)), pa.array(some), pa.array(t[some])], names=["axis", "level", "value"])

        got = coded.select("source", "lang", "topic", "tokens").mapInArrow(run, "axis long, level long, value double").groupBy("axis", "level").agg(F.sum("value").alias("value")).toPandas()
        out = tuple(np.zeros(n) for n in sizes)
        for axis, level, value in zip(got["axis"], got["level"], got["value"]):
            out[axis][level] = value
        known.unpersist()
        return out

    return sums


def rake(tokens: np.ndarray, source: np.ndarray, lang: np.ndarray, topic: np.ndarray, wanted: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Weights (copies) per cell. The source marginal `wanted` holds exactly wherever `most` copies of a source allow it;
    the language and topic shares come as near to their natural ones as that leaves room for. No weight passes `most`."""
    if not len(tokens) or not tokens.sum():
        return np.zeros(len(tokens))
    room = most * np.bincount(source, tokens, len(wanted))
    langs, topics = np.bincount(lang, tokens), np.bincount(topic, tokens)
    a, b, c = fit_factors(local_sums(tokens, source, lang, topic, most, len(langs), len(topics)), np.minimum(wanted, room), room, langs, topics)
    return cell_weights(a[source], b[lang], c[topic], most[source])


@dataclass
class Mixture:
    """cells(source, lang, topic, tokens, copies) of the wanted sources; limits: for each target its share, max_repeats, size,
    wanted tokens, fitted tokens, and whether it stays short."""

    cells: DataFrame
    limits: DataFrame


def _coded(cells: DataFrame, names: list[str]) -> tuple[DataFrame, dict[str, dict[str, int]]]:
    """Cells with their levels as numbers. The levels of one column reach the driver, never the cells."""
    levels = {c: {r[0]: n for n, r in enumerate(cells.select(c).distinct().orderBy(c).collect())} for c in ("lang", "topic")}
    levels["source"] = {n: k for k, n in enumerate(names)}
    spark = cells.sparkSession
    for c, known in levels.items():
        table = spark.createDataFrame(pa.table({c: pa.array(list(known), pa.string()), f"{c}_no": pa.array(list(known.values()), pa.int64())}))
        cells = cells.join(table, c)
    return cells.select("source", "lang", "topic", *(F.col(f"{c}_no") for c in ("source", "lang", "topic")), F.col("tokens").cast("double").alias("weight")), levels


def plan_mixture(df: DataFrame, targets: DataFrame, text_col: str = "text", source_col: str = "source", lang_col: str = "lang", topic_col: str = "category", driver_cells: int = DRIVER_CELLS) -> Mixture:
    """The fitted mixture. `targets` has source, target_share and max_repeats.

    Wanted tokens are target_share x the tokens of all rows, also those without a source. A source without rows has size 0.
    The corpus is read once, pre-aggregated to cells that are stored; all levels of languages and topics are kept. A source
    that stands twice in the targets raises ValueError.
    """
    spark = df.sparkSession
    cells = _prepared(df, text_col, source_col, lang_col, topic_col).groupBy("source", "lang", "topic").agg(F.sum("tokens").alias("tokens"))
    cells = write_shared(cells, "cells")
    goals = targets.select(clean_source(targets["source"]).alias("source"), "target_share", "max_repeats").collect()
    names = [g[0] for g in goals]
    if len(set(names)) < len(names):
        raise ValueError("a source stands twice in the targets")
    total, = cells.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()
    own = cells.where(F.col("source").isin([n for n in names if n is not None]))
    wanted, most = np.array([float(g[1]) * total for g in goals]), np.array([float(g[2]) for g in goals])
    if own.count() <= driver_cells:
        rows = own.toArrow()
        tokens = rows["tokens"].to_numpy().astype(float)
        code = {c: rows[c].combine_chunks().dictionary_encode() for c in ("lang", "topic")}
        lang, topic = (code[c].indices.to_numpy(zero_copy_only=False).astype(int) for c in ("lang", "topic"))
        source = np.array([names.index(x) for x in rows["source"].to_pylist()], dtype=int)
        weight = rake(tokens, source, lang, topic, wanted, most)
        size, fitted = (np.bincount(source, x, len(names)) for x in (tokens, weight * tokens))
        plan = spark.createDataFrame(pa.table({"source": rows["source"].cast(pa.string()), "lang": rows["lang"].cast(pa.string()), "topic": rows["topic"].cast(pa.string()), "tokens": pa.array(tokens), "copies": pa.array(weight)}))
    else:
        coded, levels = _coded(own, names)
        coded = write_shared(coded, "coded")
        numbers = coded.select(F.col("source_no").alias("source"), F.col("lang_no").alias("lang"), F.col("topic_no").alias("topic"), F.col("weight").alias("tokens"))
        sums = spread_sums(numbers, np.full(len(names), 1.0), len(levels["lang"]), len(levels["topic"]))
        size, langs, topics = sums(np.ones(len(names)), np.ones(len(levels["lang"])), np.ones(len(levels["topic"])))
        sums = spread_sums(numbers, most, len(langs), len(topics))
        a, b, c = fit_factors(sums, np.minimum(wanted, most * size), most * size, langs, topics)
        fitted = sums(a, b, c)[0]
        factor = lambda c, values, name: spark.createDataFrame(pa.table({f"{c}_no": pa.array(range(len(values)), pa.int64()), name: pa.array(values, pa.float64())}))
        joined = coded.join(factor("source", a, "a"), "source_no").join(factor("source", most, "most"), "source_no").join(factor("lang", b, "b"), "lang_no").join(factor("topic", c, "c"), "topic_no")
        plan = joined.select("source", "lang", "topic", F.col("weight").alias("tokens"), F.least("most", F.col("a") * F.col("b") * F.col("c")).alias("copies"))
    limits = spark.createDataFrame(
        [(n, float(g[1]), int(g[2]), int(s), float(w), float(f), bool(f >= g[2] * s * (1 - 1e-6) and w > g[2] * s)) for n, g, s, w, f in zip(names, goals, size, wanted, fitted)],
        "source string, target_share double, max_repeats int, size_tokens long, wanted_tokens double, fitted_tokens double, short boolean",
    )
    return Mixture(plan, limits)


def _drawn(df: DataFrame, mixture: Mixture, text_col: str, source_col: str, lang_col: str, topic_col: str, id_col: str, seed: int) -> DataFrame:
    rows = _prepared(df, text_col, source_col, lang_col, topic_col, id_col).where(F.col("tokens") > 0)
    chance = (F.xxhash64(F.lit(seed), F.col("row_id")).bitwiseAND(F.lit((1 << 52) - 1)) / F.lit(float(1 << 52)))
    joined = rows.join(mixture.cells.select("source", "lang", "topic", F.col("copies").alias("weight")), ["source", "lang", "topic"])
    copies = (F.floor("weight") + (chance < F.col("weight") - F.floor("weight")).cast("int")).cast("int")
    return joined.select(F.col("row_id").alias(id_col), "source", "tokens", copies.alias("copies")).where(F.col("copies") > 0)


def mix_sources(df: DataFrame, targets: DataFrame, text_col: str = "text", source_col: str = "source", lang_col: str = "lang", topic_col: str = "category", id_col: str = "doc_id", seed: int = 20, driver_cells: int = DRIVER_CELLS) -> DataFrame:
    """The drawn rows: `id_col`, source, tokens, copies (1 to max_repeats).

    A row of a cell with weight w is taken floor(w) times and once more with the chance w - floor(w), decided by a hash
    of its id, so the draw is the same on any cluster. Rows without a target source, and rows of no tokens, are not
    drawn. Rows with the same id share their draw; a null id is drawn like any other. Texts are read twice, once for the
    cells and once for the draw.
    """
    mixture = plan_mixture(df, targets, text_col, source_col, lang_col, topic_col, driver_cells)
    return _drawn(df, mixture, text_col, source_col, lang_col, topic_col, id_col, seed)


def mixture_report(df: DataFrame, targets: DataFrame, text_col: str = "text", source_col: str = "source", lang_col: str = "lang", topic_col: str = "category", id_col: str = "doc_id", seed: int = 20) -> DataFrame:
    """Per target source: wanted and drawn tokens, wanted and actual share, copies of its most repeated row."""
    mixture = plan_mixture(df, targets, text_col, source_col, lang_col, topic_col)
    drawn = _drawn(df, mixture, text_col, source_col, lang_col, topic_col, id_col, seed)
    got = write_shared(drawn.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("drawn_tokens"), F.max("copies").alias("most_copies"), F.count("*").alias("drawn_rows")), "drawn")
    whole = got.agg(F.sum("drawn_tokens").alias("all_tokens"))  # one row
    return mixture.limits.join(got, "source", "left").crossJoin(F.broadcast(whole)).select(
        "source", "target_share", "max_repeats", "size_tokens", "wanted_tokens", "fitted_tokens", "short",
        F.coalesce("drawn_tokens", F.lit(0)).alias("drawn_tokens"), F.coalesce("drawn_rows", F.lit(0)).alias("drawn_rows"), F.coalesce("most_copies", F.lit(0)).alias("most_copies"),
        F.coalesce(F.col("drawn_tokens") / F.nullif(F.col("all_tokens"), F.lit(0)), F.lit(0.0)).alias("actual_share"),
    )


def unreachable_sources(df: DataFrame, targets: DataFrame, **columns: str) -> DataFrame:
    """Targets whose fitted weights all stand at `max_repeats` and that even so, exactly counted, don't reach their tokens."""
    return plan_mixture(df, targets, **columns).limits.where("short").select("source")
