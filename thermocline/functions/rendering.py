"""Profile text as column expressions."""

from pyspark.sql import Column, functions as F


def pad(text: Column, width: int) -> Column:
    """Left-pad to ``width`` without ever cutting a longer text."""
    return F.lpad(text, F.greatest(F.length(text), F.lit(width)), F.lit(" "))


def fixed_point(value: Column, digits: int, width: int = 0) -> Column:
    """``value`` with ``digits`` decimals, half up.

    A decimal cast is about three times as fast as ``format_string``, which is kept for
    magnitudes beyond the decimal's range.
    """
    exact = value.try_cast(f"decimal(18,{digits})")
    plain = exact.cast("string")
    signed = F.when((value < 0) & (exact == 0), F.concat(F.lit("-"), plain)).otherwise(plain)
    text = (F.when(value.isNull() | F.isnan(value), F.lit("nan"))
            .otherwise(F.coalesce(signed, F.format_string(f"%.{digits}f", value))))
    return pad(text, width) if width else text


def fixed_point_length(value: Column, digits: int, width: int) -> Column:
    """Length of ``fixed_point``, without rendering it where the value fits its field."""
    high, low = 10 ** (width - digits - 1) - 1, 1 - 10 ** (width - digits - 2)
    return (F.when((value > low) & (value < high), F.lit(width))
            .otherwise(F.length(fixed_point(value, digits, width))))


def timestamp_text(ts: Column) -> Column:
    """Seconds, and microseconds only where there are any."""
    micros = F.date_format(ts, "SSSSSS")
    seconds = F.date_format(ts, "yyyy-MM-dd HH:mm:ss")
    return F.when(micros == "000000", seconds).otherwise(F.concat(seconds, F.lit("."), micros))


def measurement_line(number: Column, pressure: Column, temperature: Column, salinity: Column) -> Column:
    # Fixed text format.
    return F.concat(
        F.lit("  "), pad(number.cast("string"), 3),
        F.lit(". Pressure: "), fixed_point(pressure, 1, 6),
        F.lit(" dbar, Temperature: "), fixed_point(temperature, 3, 6),
        F.lit("°C, Salinity: "), fixed_point(salinity, 3, 6),
        F.lit(" PSU"),
    )


def measurement_line_length(pressure: Column, temperature: Column, salinity: Column) -> Column:
    """Length of a line whose number has at most three digits."""
    fixed = len("  nnn. Pressure:  dbar, Temperature: °C, Salinity:  PSU")
    return (fixed + fixed_point_length(pressure, 1, 6) + fixed_point_length(temperature, 3, 6)
            + fixed_point_length(salinity, 3, 6))


def _line_of(m: Column, i: Column) -> Column:
    return measurement_line(i + 1, m["pressure_decibar"], m["temperature_degc"], m["salinity_psu"])


def profile_header(meta: Column, points: Column) -> Column:
    """The lines above the measurement list; ``meta`` is a struct of profile metadata."""
    def text(name):
        return F.coalesce(meta[name].cast("string"), F.lit("None"))

    # Fixed text format.
    return F.concat(
        F.lit("ARGO Float Profile - Timestamp: "), text("timestamp"),
        F.lit("\nLocation: "), fixed_point(meta["latitude"], 6),
        F.lit("°N, "), fixed_point(meta["longitude"], 6),
        F.lit("°E\nBasin: "), text("basin"), F.lit(", Cycle: "), text("cycle_number"),
        F.lit("\nSampling Scheme: "), text("vertical_sampling_scheme"),
        F.lit("\nProfile Depth Points: "), points.cast("string"),
        F.lit("\n"),
    )


LIST_TITLE = "\nDepth Profile Measurements:"


def profile_text(meta: Column, measurements: Column) -> Column:
    """Header and every measurement, numbered from one."""
    lines = F.transform(measurements, _line_of)
    return F.concat(profile_header(meta, F.size(measurements)), F.lit(LIST_TITLE + "\n"),
                    F.array_join(lines, "\n"))


def preview_text(meta: Column, measurements: Column, shown: int = 10) -> Column:
    """The retrieval view: the first ``shown`` lines and how many more there are."""
    n = F.size(measurements)
    lines = F.array_join(F.transform(F.slice(measurements, 1, shown), _line_of), "\n")
    more = F.when(n > shown, F.concat(F.lit("\n  ... and "), (n - shown).cast("string"),
                                      F.lit(" more measurements"))).otherwise(F.lit(""))
    body = F.when(n > 0, F.concat(F.lit(LIST_TITLE + "\n"), lines, more)).otherwise(F.lit(""))
    return F.when(meta.isNull(), F.lit("")).otherwise(F.concat(profile_header(meta, n), body))


def measurement_phrase(measurements: Column, used: int = 5) -> Column:
    """A search sentence made of the first few measurements of a profile."""
    # Fixed text format.
    phrases = F.transform(F.slice(measurements, 1, used), lambda m: F.concat(
        F.lit("Depth "), fixed_point(m["pressure_decibar"], 1),
        F.lit("m: temperature "), fixed_point(m["temperature_degc"], 2),
        F.lit("°C, salinity "), fixed_point(m["salinity_psu"], 2)))
    return F.concat(F.lit("Oceanographic profile with measurements: "), F.array_join(phrases, "; "))
