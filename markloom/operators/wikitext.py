"""Functions on one text, run over tables: Arrow batches in, Arrow batches out, no shuffle.

Edge cases: null texts are read as empty; columns keep their values, and a new
column of the same name wins; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame

_TYPES = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string())}


def _fields(fields: str) -> list[tuple[str, pa.DataType]]:
    return [(name, _TYPES[kind]) for name, kind in (x.split() for x in fields.split(", "))]


def _inputs(batch: pa.RecordBatch, names: list[str]):
    columns = [batch.column(batch.schema.get_field_index(n)) for n in names]
    return zip(*([("" if v is None and pa.types.is_string(c.type) else v) for v in c.to_pylist()] for c in columns), strict=True)  # lists and numbers keep their nulls


def mapped(df: DataFrame, fn: Callable[..., tuple], fields: str, *inputs: str) -> DataFrame:
    """df with the fields that fn makes of each row's inputs."""
    new = _fields(fields)
    keep = [f for f in df.schema.fields if f.name not in {n for n, _ in new}]

    def run(batches):
        for batch in batches:
            made = [fn(*row) for row in _inputs(batch, list(inputs))]
            own = [batch.column(batch.schema.get_field_index(f.name)) for f in keep]
            yield pa.RecordBatch.from_arrays([*own, *(pa.array([m[i] for m in made], t) for i, (_, t) in enumerate(new))], [*(f.name for f in keep), *(n for n, _ in new)])

    return df.mapInArrow(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in keep), fields]))


def exploded(df: DataFrame, fn: Callable[..., list[tuple]], fields: str, inputs: list[str], keep: list[str]) -> DataFrame:
    """A row for each tuple that fn makes of a row's inputs: the kept columns, ord from 0 and the fields."""
    new = _fields(fields)
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}

    def run(batches):
        for batch in batches:
            made = [fn(*row) for row in _inputs(batch, inputs)]
            take = pa.array([i for i, rows in enumerate(made) for _ in rows], pa.int64())
            flat = [r for rows in made for r in rows]
            own = [batch.column(batch.schema.get_field_index(k)).take(take) for k in keep]
            place = pa.array([j for rows in made for j in range(len(rows))], pa.int64())
            yield pa.RecordBatch.from_arrays([*own, place, *(pa.array([r[i] for r in flat], t) for i, (_, t) in enumerate(new))], [*keep, "ord", *(n for n, _ in new)])

    return df.select(*dict.fromkeys([*keep, *inputs])).mapInArrow(run, ", ".join([*(f"`{k}` {kinds[k]}" for k in keep), "ord long", fields]))


def findings(df: DataFrame, check: Callable[[str], list], text: str, keep: list[str]) -> DataFrame:
    """V10, V11, V13 and each check: the kept columns and a row a finding."""
    from ..functions.checks import FIELDS

    return exploded(df, check, FIELDS, [text], keep)


def validity(df: DataFrame, text: str, key: str) -> DataFrame:
    """V10. (key, valid, kinds): whether a text has no finding, and the kinds it has, in order."""
    from ..functions.checks import validated

    def row(x: str) -> tuple:
        kinds = [f[0] for f in validated(x)]
        return not kinds, list(dict.fromkeys(kinds))

    return mapped(df.select(key, text), row, "valid boolean, kinds array<string>", text).drop(text)


def article_chunks(articles: DataFrame, least: int, most: int) -> DataFrame:
    """P09. articles (article, text): (article, ord, titles, text, tokens) of every chunk, cut before headings first."""
    from ..functions.chunks import chunks, token_count

    def rows(text: str) -> list[tuple]:
        return [(titles, body, token_count(body)) for titles, body in chunks(sections(text), least, most)]

    return exploded(articles, rows, "titles array<string>, text string, tokens long", ["text"], ["article"])


def sections(text: str) -> list[tuple[str, str]]:
    """P01. (title, text) of the parts between headings, those outside comments and templates only; blank ones are dropped."""
    from ..functions.wiki import Markup, is_heading

    hidden = [(e.start, e.end) for e in Markup(text).top() if e.kind in ("template", "comment", "tag", "table")]
    out, at, k = [["Lead", ""]], 0, 0
    for line in text.splitlines(keepends=True):
        while k < len(hidden) and hidden[k][1] <= at:
            k += 1
        if line.startswith("=") and is_heading(line) and not (k < len(hidden) and hidden[k][0] < at):
            out.append([line.strip().strip("=").strip(), ""])
        out[-1][1] += line
        at += len(line)
    return [(title, body) for title, body in out if body.strip()]
