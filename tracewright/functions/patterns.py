"""Column helpers over token sequences: motifs and hierarchical n-gram patterns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def motif(tokens: Column) -> Column:
    return F.array_join(tokens, ">")


def _none() -> Column:
    return F.array().cast("array<string>")


def grams(tokens: Column, n: int, prefix: str) -> Column:
    """Contiguous runs of n tokens, prefixed; none where there are fewer."""
    each = F.transform(F.sequence(F.lit(1), F.size(tokens) - (n - 1)), lambda k: F.concat(F.lit(prefix + ":"), F.array_join(F.slice(tokens, k, n), ">")))
    return F.when(F.size(tokens) >= n, each).otherwise(_none())


def patterns(tokens: Column) -> Column:
    """Distinct, sorted ACTION, BIGRAM, TRIGRAM, ENDPOINT (over 2 tokens) and FULL (4 to 6 tokens) patterns."""
    ends = F.when(F.size(tokens) > 2, F.array(F.concat(F.lit("ENDPOINT:"), F.element_at(tokens, 1), F.lit(">"), F.element_at(tokens, -1)))).otherwise(_none())
    full = F.when(F.size(tokens).between(4, 6), F.array(F.concat(F.lit("FULL:"), motif(tokens)))).otherwise(_none())
    return F.array_sort(F.array_distinct(F.concat(grams(tokens, 1, "ACTION"), grams(tokens, 2, "BIGRAM"), grams(tokens, 3, "TRIGRAM"), ends, full)))


def canonical_patterns(found: Column, motif_text: Column) -> Column:
    """Patterns under their canonical kind: short FULLs by length, a two-token ENDPOINT that is the whole motif as BIGRAM; none at all: the motif as FULL."""
    given = F.when(F.size(F.coalesce(found, _none())) > 0, found).otherwise(F.array(F.concat(F.lit("FULL:"), motif_text)))

    def canonical(value: Column) -> Column:
        prefix = F.substring_index(value, ":", 1)
        body = F.when(F.instr(value, ":") > 0, F.substring(value, F.instr(value, ":") + 1, F.length(value))).otherwise("")
        size = F.size(F.split(body, ">"))
        short = F.when(size == 1, "ACTION").when(size == 2, "BIGRAM").otherwise("TRIGRAM")
        kind = F.when((prefix == "FULL") & (size <= 3), short).when((prefix == "ENDPOINT") & (F.size(F.split(motif_text, ">")) == 2) & (body == motif_text), "BIGRAM").otherwise(prefix)
        return F.concat(kind, F.lit(":"), body)

    return F.array_sort(F.array_distinct(F.transform(given, canonical)))
