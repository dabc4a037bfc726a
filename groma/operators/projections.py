"""What of a table may be shown: secrets are left out, also within structs and lists of them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StructType


def _without(value: Column, kind: DataType, path: list[str]) -> Column:
    if isinstance(kind, ArrayType):
        return F.transform(value, lambda x: _without(x, kind.elementType, path))
    if not isinstance(kind, StructType) or path[0] not in kind.fieldNames():
        return value
    if len(path) == 1:
        return value.dropFields(f"`{path[0]}`")
    inner = _without(value[path[0]], kind[path[0]].dataType, path[1:])
    return value.withField(f"`{path[0]}`", inner)


def public(df: DataFrame, secrets: Sequence[str], derived: Mapping[str, Column] | None = None) -> DataFrame:
    """df without the secret columns, which may be paths into structs and lists (``payload.token``), and with derived ones, which may look at secrets. Names that the table lacks are an error: a secret that is misspelt would be shown."""
    made = df.select("*", *[c.alias(f"__{n}") for n, c in (derived or {}).items()])
    columns = {c: F.col(f"`{c}`") for c in df.columns}
    kinds = {f.name: f.dataType for f in df.schema.fields}
    for secret in secrets:
        head, *path = secret.split(".")
        if head not in kinds or (path and not _has(kinds[head], path)):
            raise ValueError(f"there is no column {secret}")
        if path:
            columns[head] = _without(columns[head], kinds[head], path)
        else:
            del columns[head]
    return made.select(*[v.alias(c) for c, v in columns.items() if c not in (derived or {})], *[F.col(f"`__{n}`").alias(n) for n in derived or {}])


def _has(kind: DataType, path: list[str]) -> bool:
    if isinstance(kind, ArrayType):
        return _has(kind.elementType, path)
    return isinstance(kind, StructType) and path[0] in kind.fieldNames() and (len(path) == 1 or _has(kind[path[0]].dataType, path[1:]))


def source_links(*, url: str, key: Column, has_preview: Column, kind: Column, job_status: Column, lease_until: Column, attempt: Column) -> dict[str, Column]:
    """Derived columns of a source: where its preview is, when a lost connection is tried again, and which attempt it is.

    attempt: null where there is no job yet; a stream's first attempt is 1.
    """
    stream = F.coalesce(kind == "rtsp", F.lit(False))
    there = job_status.isNotNull()
    return {
        "preview_url": F.when(has_preview, F.format_string(url, key.cast("string"))),
        "retry_at": F.when(stream & (job_status == "queued"), lease_until),
        "connection_attempt": F.when(stream & there, F.coalesce(attempt, F.lit(1))),
    }
