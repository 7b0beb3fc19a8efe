"""A catalogue's coverage at several levels, counted in one scan, and its report.

``coverage`` groups by all levels at once (grouping sets): the whole, each value of the first column, each pair of the first two, and so on. Its rows are few
against the table's; ``report`` renders them, and the rows that are shown as an example, as Markdown.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.functions import columns as C


def coverage(df: DataFrame, levels: list[str], fields: list[str], required: list[str], key: str | None = None) -> DataFrame:
    """(level, <levels>, n_rows, n_keys, filled_<field>..., required_missing_rate, missing_rate), level 0 being the whole.

    A field is filled if it is not blank and no placeholder. ``n_keys`` counts the different keys (n_rows without a key). Rates are over all cells, to four places.
    """
    empty = {f: C.is_blank(F.col(f)) | C.text(F.col(f)).isin(C.PLACEHOLDERS) for f in fields}
    flat = df.select(*levels, *([F.col(key).alias("__key")] if key else []), *[(~empty[f]).cast("int").alias(f"__{f}") for f in fields])
    sets = [levels[:i] for i in range(len(levels) + 1)]
    depth = sum((F.lit(1) - F.grouping(x) for x in levels), F.lit(0)) if levels else F.lit(0)
    grouped = flat.groupingSets(sets, *levels) if levels else flat.groupBy()
    out = grouped.agg(
        depth.cast("int").alias("level"), F.count("*").alias("n_rows"), (F.count_distinct("__key") if key else F.count("*")).alias("n_keys"),
        *[F.coalesce(F.sum(f"__{f}"), F.lit(0)).alias(f"filled_{f}") for f in fields],
    )

    def rate(names: list[str]):
        cells = F.col("n_rows") * len(names)
        return F.when(cells > 0, F.round(1 - sum((F.col(f"filled_{f}") for f in names), F.lit(0)) / cells, 4)).otherwise(0.0)

    return out.select("level", *levels, "n_rows", "n_keys", *[f"filled_{f}" for f in fields], rate(required).alias("required_missing_rate"), rate(fields).alias("missing_rate"))


def cell(value) -> str:
    return "" if value is None else str(value).replace("|", "\\|").replace("\r", " ").replace("\n", " ")


def report(title: str, numbers: DataFrame, levels: list[str], fields: list[str], most: int = 200, examples: DataFrame | None = None, rows: int = 50) -> str:
    """Markdown: the whole in words, then a table for each level of at most ``most`` lines, the fullest groups first; then example rows."""
    whole = numbers.where("level = 0").first()
    out = [f"# {title}", ""]
    if whole is not None:
        out += [f"- rows: {whole['n_rows']}", f"- different keys: {whole['n_keys']}", f"- required cells missing: {whole['required_missing_rate']:.2%}", f"- cells missing: {whole['missing_rate']:.2%}", ""]
    for depth in range(1, len(levels) + 1):
        names = levels[:depth]
        found = numbers.where(F.col("level") == depth).orderBy(F.desc("n_rows"), *names).limit(most + 1).collect()
        out += [f"## By {', '.join(names)}", "", f"| {' | '.join([*names, 'rows', *fields])} |", "|" + " --- |" * (depth + 1 + len(fields))]
        for r in found[:most]:
            shares = [f"{r[f'filled_{f}'] / r['n_rows']:.0%}" for f in fields]
            out.append(f"| {' | '.join([*(cell(r[n]) for n in names), str(r['n_rows']), *shares])} |")
        out += [f"({most} groups are shown)", ""] if len(found) > most else [""]
    if examples is not None:
        out += ["## Rows", "", f"| {' | '.join(examples.columns)} |", "|" + " --- |" * len(examples.columns)]
        out += [f"| {' | '.join(cell(v) for v in r)} |" for r in examples.limit(rows).collect()]
    return "\n".join(out)
