"""Identity, hashing and deterministic randomness as column expressions.

Everything random is a pure function of ids, so a lost executor recomputes the
same value and another SQL engine can reproduce it.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UINT32 = 4294967296.0


def _part(p) -> Column:
    return p if isinstance(p, Column) else F.lit(str(p))


def text_hash(col: Column, length: int = 16) -> Column:
    """First ``length`` hex digits of the SHA-256 of a text."""
    return F.substring(F.sha2(col, 256), 1, length)


def stable_hash(fields: dict[str, Column], length: int = 16) -> Column:
    """Hash of a record that does not depend on the order its fields are named in."""
    ordered = [fields[name].alias(name) for name in sorted(fields)]
    doc = F.to_json(F.struct(*ordered), {"ignoreNullFields": "false"})
    return text_hash(doc, length)


def derive_seed(*parts) -> Column:
    """Unsigned 32-bit seed (as bigint) from id parts."""
    joined = F.concat_ws("|", *[_part(p).cast("string") for p in parts])
    return F.conv(text_hash(joined, 8), 16, 10).cast("bigint")


def unit_uniform(*parts) -> Column:
    """Uniform value in [0, 1) from id parts."""
    joined = F.concat_ws("|", *[_part(p).cast("string") for p in parts])
    return F.conv(F.substring(F.md5(joined), 1, 8), 16, 10).cast("bigint") / F.lit(UINT32)


def order_hash(seed, key: Column) -> Column:
    """Sort key of the seeded shuffle: 32 hex digits, uniform over keys."""
    return F.md5(F.concat_ws("|", _part(seed).cast("string"), key.cast("string")))


def composite_id(*parts) -> Column:
    """``a::b::c`` record ids."""
    return F.concat_ws("::", *[_part(p).cast("string") for p in parts])


def split_composite_id(col: Column) -> Column:
    return F.split(col, "::")


def canonical_facts(facts: Column) -> Column:
    """Trimmed, sorted, duplicates kept; a missing list counts as empty."""
    empty = F.array().cast("array<string>")
    return F.array_sort(F.transform(F.coalesce(facts, empty), lambda f: F.trim(f)))


def state_signature(
    obs: Column,
    commands: Column,
    reward: Column,
    done: Column,
    won: Column,
    facts: Column,
) -> Column:
    """Canonical form of one observed state; list order in the input is irrelevant."""
    empty = F.array().cast("array<string>")
    return F.struct(
        F.array_sort(F.coalesce(commands, empty)).alias("admissible_commands"),
        F.coalesce(done, F.lit(False)).alias("done"),
        canonical_facts(facts).alias("facts"),
        F.trim(F.coalesce(obs, F.lit(""))).alias("obs"),
        F.coalesce(reward, F.lit(0.0)).cast("double").alias("reward"),
        F.coalesce(won, F.lit(False)).alias("won"),
    )


def signature_hash(signature: Column) -> Column:
    """32 hex digits over the canonical state."""
    return text_hash(F.to_json(signature), 32)
