"""Formatting and small arithmetic as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UNITS = ["B", "KB", "MB", "GB", "TB", "PB", "EB"]


def format_bytes(n: Column) -> Column:
    """`1.5 KB`: steps of 1024, at most two decimals, halves away from zero; negative numbers are an error."""
    text = F.lit(None).cast("string")
    for k in reversed(range(len(UNITS))):
        size = F.round((n / F.lit(float(1024**k))).cast("decimal(38,12)"), 2)
        shown = F.regexp_replace(F.regexp_replace(size.cast("decimal(38,2)").cast("string"), r"(\.\d*?)0+$", "$1"), r"\.$", "")
        text = F.when(n < 1024 ** (k + 1), F.concat(shown, F.lit(f" {UNITS[k]}"))).otherwise(text) if k < len(UNITS) - 1 else F.concat(shown, F.lit(f" {UNITS[k]}"))
    return F.when(n < 0, F.raise_error(F.lit("negative number of bytes"))).otherwise(text)


def format_duration(seconds: Column) -> Column:
    """`59s`, `2m 30s`, `1h 15m`, `2d 1h 0m`, cut off; negative and infinite numbers are an error."""
    bad = (seconds < 0) | F.isnan(seconds) | (seconds == float("inf"))
    s = F.floor(F.when(~bad, seconds))
    m, h = F.floor(s / 60), F.floor(s / 3600)
    t = lambda c: c.cast("long").cast("string")
    text = (
        F.when(s < 60, F.concat(t(s), F.lit("s")))
        .when(s < 3600, F.concat(t(m), F.lit("m "), t(s % 60), F.lit("s")))
        .when(h < 24, F.concat(t(h), F.lit("h "), t(m % 60), F.lit("m")))
        .otherwise(F.concat(t(F.floor(h / 24)), F.lit("d "), t(h % 24), F.lit("h "), t(m % 60), F.lit("m")))
    )
    return F.when(bad, F.raise_error(F.lit("not a duration"))).otherwise(text)


def throughput_mb(n: Column, seconds: Column) -> Column:
    return F.when(seconds > 0, n / seconds / 1048576).otherwise(0.0)


def eta_seconds(done: Column, total: Column, per_second: Column) -> Column:
    return F.when(per_second > 0, (total - done) / per_second)


def next_power_of_two(n: Column) -> Column:
    return F.when(n <= 1, 1).otherwise(F.pow(F.lit(2.0), F.ceil(F.log2(n)))).cast("long")


def adaptive_concurrency(max_chunk: Column, budget: int = 384 << 20, least: int = 4, most: int = 24) -> Column:
    return F.least(F.greatest(F.floor(F.lit(budget) / F.greatest(max_chunk, F.lit(1))), F.lit(least)), F.lit(most)).cast("int")


def file_concurrency(budget_mb: Column, most: int = 16) -> Column:
    return F.least(F.greatest(F.floor(budget_mb / 512), F.lit(1)), F.lit(most)).cast("int")


def transient_status(code: Column) -> Column:
    return code.isin(408, 429, 500, 502, 503, 504)


def strong_password(p: Column) -> Column:
    """Twelve characters at least, with lower and upper case, a digit and something else."""
    return (F.length(p) >= 12) & p.rlike(r"\p{Lower}") & p.rlike(r"\p{Upper}") & p.rlike("[0-9]") & p.rlike(r"[^\p{L}0-9]")


def unaccounted_memory(working_set: Column, used: Column, pooled: Column, large: Column, small: Column) -> Column:
    return F.greatest(F.lit(0), working_set - F.greatest(F.lit(0), used - pooled) - large - small)


def stamp(name: Column) -> Column:
    """The UTC time in `...yyyyMMdd-HHmmss...`; null if there is none."""
    return F.try_to_timestamp(F.nullif(F.regexp_extract(name, r"(\d{8}-\d{6})", 1), F.lit("")), F.lit("yyyyMMdd-HHmmss"))


def summary_text(**counts: Column) -> Column:
    """`3 to create, 1 to delete`: the parts that aren't zero."""
    return F.concat_ws(", ", *[F.when(c > 0, F.concat(c.cast("string"), F.lit(f" to {name}"))) for name, c in counts.items()])


def ewma(samples: Column, alpha: float = 0.3) -> Column:
    """Exponentially weighted mean of an ordered array of doubles; the first sample (after zeros) seeds it."""
    return F.aggregate(samples, F.lit(0.0), lambda a, x: F.when(a == 0, x).otherwise(alpha * x + (1 - alpha) * a))


def connections(samples: Column, start: int, least: int, most: int, alpha: float = 0.3, band: float = 0.05) -> Column:
    """Additive increase, multiplicative decrease over an ordered array of throughput samples: the number of connections at the end."""
    state = F.struct(F.lit(0.0).alias("mean"), F.lit(start).alias("n"))

    def step(a: Column, x: Column) -> Column:
        delta = (x - a["mean"]) / a["mean"]
        n = (
            F.when((a["mean"] == 0) | (x == 0), a["n"])
            .when(delta > band, F.least(F.lit(most), a["n"] + F.when(delta > 4 * band, 2).otherwise(1)))
            .when(delta < -band, F.greatest(F.lit(least), F.floor(a["n"] / 2).cast("int")))
            .otherwise(a["n"])
        )
        return F.struct(F.when(a["mean"] == 0, x).otherwise(alpha * x + (1 - alpha) * a["mean"]).alias("mean"), n.cast("int").alias("n"))

    return F.aggregate(samples, state, step)["n"]


LEAST_MB, DEFAULT_CAP_MB = 512, 8192


def memory_steps(total_mb: Column) -> Column:
    """Limits to choose from: doubling from the least on, ending with all of the memory."""
    powers = F.transform(F.sequence(F.lit(0), F.lit(30)), lambda i: F.lit(LEAST_MB).cast("long") * F.pow(F.lit(2.0), i).cast("long"))
    below = F.filter(powers, lambda p: p < total_mb)
    return F.when(total_mb <= 0, F.array(F.lit(LEAST_MB).cast("long"))).otherwise(F.concat(below, F.array(total_mb.cast("long"))))


def memory_severity(limit_mb: Column, total_mb: Column) -> Column:
    ratio = limit_mb / total_mb
    return F.when(total_mb <= 0, "Safe").when(ratio <= 0.5, "Safe").when(ratio <= 0.8, "Aggressive").otherwise("Dangerous")


def default_limit(total_mb: Column) -> Column:
    """The greatest step within a quarter of the memory, the cap at most; the cap itself if the memory is unknown."""
    fit = F.array_max(F.filter(memory_steps(total_mb), lambda s: s <= F.floor(total_mb / 4)))
    return F.when(total_mb <= 0, DEFAULT_CAP_MB).otherwise(F.least(F.coalesce(fit, F.lit(LEAST_MB)), F.lit(DEFAULT_CAP_MB)))


def progress_text(done: Column, total: Column, seconds: Column) -> Column:
    """Speed and time left, `1 MB/s, 10s remaining`; without time left once all is done."""
    speed = done / seconds
    left = F.when((speed > 0) & (total > done), F.concat(F.lit(", "), format_duration((total - done) / speed), F.lit(" remaining"))).otherwise("")
    return F.when((seconds > 0) & (done > 0), F.concat(format_bytes(speed.cast("long")), F.lit("/s"), left)).otherwise("")


def detail_json(**values: Column) -> Column:
    """A JSON object of typed scalars; nulls are kept."""
    return F.to_json(F.struct(*[v.alias(k) for k, v in values.items()]), {"ignoreNullFields": "false"})
