"""Tokens of each section of a document, from one encoding of the whole document.

The fields of a row are joined by line feeds and encoded once. A byte-level
token's bytes are known, so running sums of their lengths give each token's span;
spans are joined to the sections by their sorted borders. Counting sections on
their own would tokenize differently at every border.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from .common import table

FIELDS = ("source", "lang", "text")
RULES = ("most", "first", "last")


@lru_cache(maxsize=2)
def _encoding(path: str):
    import base64

    import public_tokenizers
    import tiktoken

    with open(path, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    sizes = np.zeros(max(ranks.values()) + 1, np.int64)
    for token, rank in ranks.items():
        sizes[rank] = len(token)
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}), sizes


def allot(ends: np.ndarray, borders: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Section of each token, and whether it lies in several. ``ends``: ends of the
    adjoining token spans; ``borders``: start of each section, then the end."""
    starts = np.append(0, ends[:-1])
    first = np.searchsorted(borders, starts, "right") - 1
    last = np.searchsorted(borders, ends - 1, "right") - 1
    crossing = first != last
    if rule == "last":
        return last, crossing
    section = first.copy()
    if rule == "most":
        for i in np.flatnonzero(crossing):
            cuts = np.clip(borders[first[i]: last[i] + 2], starts[i], ends[i])
            section[i] = first[i] + int(np.diff(cuts).argmax())  # the earlier one of equals
    return section, crossing


def section_tokens(docs: DataFrame, ranks: str, fields: Sequence[str] = FIELDS, rule: str = "most",
                   id_col: str = "doc_id") -> DataFrame:
    """One row per section: doc_id, field, section, n_bytes, n_tokens, n_shared.

    A field's sections are its lines, each with the line feed after it; the one
    that joins two fields belongs to the earlier. A missing field is left out, an
    empty one is one section. A token over a border counts once, whole: where most
    of its bytes lie (the earlier section of equals), or with ``rule`` "first" or
    "last" where it begins or ends; ``n_shared`` tells how many of the tokens such
    ones are. So the sum over a row's sections is the count for the whole row. A
    row without any field has no sections. Repeated rows give repeated results;
    further columns are ignored.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")

    def count(batches):
        encoding, sizes = _encoding(ranks)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                rows = batch.slice(at, 500)
                columns = [rows.column(i + 1).to_pylist() for i in range(len(fields))]
                owner, name, number, n_bytes, n_tokens, n_shared = [], [], [], [], [], []
                for row, values in enumerate(zip(*columns)):
                    there = [(f, v) for f, v in zip(fields, values) if v is not None]
                    if not there:
                        continue
                    text = "\n".join(v for _, v in there)
                    # a break after each line; the last line of the last field has none
                    breaks = np.flatnonzero(np.frombuffer(text.encode(), np.uint8) == 10) + 1
                    size = len(text.encode())
                    lines = [v.count("\n") + 1 for _, v in there]
                    borders = np.concatenate([[0], breaks, [size]])
                    tokens = np.array(encoding.encode_ordinary(text), np.int64)
                    ends = np.cumsum(sizes[tokens])
                    k = len(borders) - 1
                    if len(ends):
                        section, crossing = allot(ends, borders, rule)
                        n_tokens.append(np.bincount(section, minlength=k)[:k])
                        n_shared.append(np.bincount(section[crossing], minlength=k)[:k])
                    else:
                        n_tokens.append(np.zeros(k, np.int64))
                        n_shared.append(np.zeros(k, np.int64))
                    owner.append(np.full(k, row))
                    n_bytes.append(np.diff(borders))
                    for (field, _), n in zip(there, lines):
                        name += [field] * n
                        number.append(np.arange(n))
                join = lambda parts: pa.array(np.concatenate(parts) if parts else np.zeros(0, np.int64), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [rows.column(0).take(join(owner)), pa.array(name, pa.string()), join(number), join(n_bytes), join(n_tokens), join(n_shared)],
                    ["doc_id", "field", "section", "n_bytes", "n_tokens", "n_shared"])

    picked = docs.select(F.col(id_col).alias("doc_id"), *[F.col(f).cast("string").alias(f"f{i}") for i, f in enumerate(fields)])
    schema = T.StructType([picked.schema["doc_id"], T.StructField("field", T.StringType())] + [
        T.StructField(k, T.LongType()) for k in ("section", "n_bytes", "n_tokens", "n_shared")])
    return picked.mapInArrow(count, schema)


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return section_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


QUERIES = {"op3_token_counts": op3_token_counts}
SQL: dict[str, str] = {}
