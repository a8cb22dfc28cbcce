"""Column expressions: predicates and projections over labels, features, colours and tiles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType


def remap(label: Column, new: dict[int, int | None]) -> Column:
    """The label's new id; 0 if it is mapped to None or not mapped."""
    pairs = [F.lit(x) for k, v in new.items() if v is not None for x in (k, v)]
    return F.coalesce(F.element_at(F.create_map(*pairs).cast("map<bigint,bigint>"), label.cast("long")), F.lit(0).cast("long")) if pairs else F.lit(0).cast("long")


def gather(feat: Column, selected: Sequence[int]) -> Column:
    """The selected elements (from 0) of an array, in that order."""
    return F.transform(F.array(*map(F.lit, selected)), lambda i: F.get(feat, i))


def all_finite(feat: Column) -> Column:
    """Whether no element is null, NaN or infinite."""
    return F.coalesce(F.forall(feat, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))), F.lit(False))


def below_share(part: Column, whole: Column, num: int, den: int) -> Column:
    """part / whole < num / den, exactly: by cross-multiplied decimals. A null part or whole is not below."""
    d = "decimal(19,0)"
    return F.coalesce(part.cast(d) * F.lit(den).cast(d) < whole.cast(d) * F.lit(num).cast(d), F.lit(False))


def low_stain(r: Column, g: Column, b: Column, saturation: int = 10, bright: int = 210) -> Column:
    """Background glass: 8-bit HSV saturation at most `saturation` and the darkest channel over `bright`."""
    top, low = F.greatest(r, g, b), F.least(r, g, b)
    s = F.when(top == 0, F.lit(0)).otherwise(F.floor(255.0 * (top - low) / top + 0.5))
    return (s <= saturation) & (low > bright)


def output_extent(n: Column, source_mpp: float, output_mpp: float) -> Column:
    """Pixels along an axis at the output spacing: the extent, rounded up."""
    return F.ceil(n * F.lit(source_mpp) / F.lit(output_mpp)).cast("long")


def blend(p: Column, palette: Sequence[Sequence[float]]) -> Column:
    """A colour for class probabilities: clipped to [0, 1], times the palette's rows, halves rounded to even."""
    clipped = F.transform(p, lambda v: F.least(F.greatest(v.cast("double"), F.lit(0.0)), F.lit(1.0)))
    dot = lambda c: sum((F.get(clipped, k) * F.lit(float(row[c])) for k, row in enumerate(palette)), F.lit(0.0))
    return F.array(*(F.rint(dot(c)).cast("int") for c in range(len(palette[0]))))


def dotted(json: Column, path: str) -> Column:
    """The text at a dotted path of a JSON document."""
    return F.get_json_object(json, "$." + path)


def require(condition: Column, message: str, value: Column) -> Column:
    """value, or an error where the condition is not true."""
    return F.when(F.coalesce(condition, F.lit(False)), value).otherwise(F.raise_error(F.lit(message)))


def spacing(x: Column, y: Column) -> Column:
    """A physical spacing, x first: both finite and positive, or an error."""
    fine = lambda v: v.isNotNull() & ~F.isnan(v) & (v > 0) & (v < F.lit(float("inf")))
    return require(fine(x) & fine(y), "spacing must be two finite positive numbers", F.struct(x.alias("x"), y.alias("y")))


def token_of(pixel: Column, pixels: int | Column, grid: int | Column) -> Column:
    """The token cell over a pixel's centre; the last cell takes what rounding puts past the end."""
    n, g = (F.lit(v) if isinstance(v, int) else v for v in (pixels, grid))
    return F.least(F.floor((pixel + 0.5) * g / n), (g - 1).cast("long")).cast("long")


#: Columns that a kind of features has. Fixed values.
FEATURE_WIDTHS = {"virchow2-spatial": 1280, "virchow2-pooled": 2560}


def feature_contract(table: DataFrame, kind: str, columns: Sequence[str], encoder: str = "encoder") -> DataFrame:
    """The table, once its schema is what a head of this kind was trained on; rows of an unnamed encoder are an error when read.

    The table begins with `columns`, in that order, numbers all, as many as the kind has; the struct column `encoder` holds
    a revision and a SHA-256 in lower case.
    """
    lead = table.schema.fields[: FEATURE_WIDTHS.get(kind, 0)]
    if not lead or [f.name for f in lead] != list(columns) or len({f.name for f in lead}) < len(lead):
        raise ValueError(f"the table does not begin with the ordered columns of {kind}")
    if odd := [f.name for f in lead if not isinstance(f.dataType, NumericType)]:
        raise ValueError(f"not numbers: {', '.join(odd)}")
    by = F.col(encoder)
    named = (F.length(by["revision"]) > 0) & by["sha256"].rlike("^[0-9a-f]{64}$")
    return table.withColumn(encoder, require(named, "the encoder needs a revision and a SHA-256", by))
