"""Column expressions over profiles (arrays of doubles by gate) and their flags. A missing value is NULL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bits of the quality mask.
QUALITY = {"precipitation": 1, "fog": 2, "low_snr": 4, "saturated": 8, "instrument_warning": 16, "instrument_alarm": 32, "window_contaminated": 64, "no_detection": 128}
#: Profiles that no layers are claimed for; the wider mask adds those without any detection.
SCREENED, SCREENED_WIDE = 39, 167
#: Limits of the byte scale, in decades.
VMIN, VMAX = -7.5, -3.5


def column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def quantise(value: Column | str, vmin: float = VMIN, vmax: float = VMAX) -> Column:
    """0 for a missing value, 1 for one that is not positive, else 1..255 over the decades vmin..vmax."""
    v = column(value)
    scaled = (F.log10(F.when(v > 0, v)) - F.lit(float(vmin))) / F.lit(max(float(vmax) - float(vmin), 1e-9))
    code = F.rint(F.greatest(F.least(scaled, F.lit(1.0)), F.lit(0.0)) * F.lit(254.0)) + F.lit(1.0)
    return F.when(v.isNull() | F.isnan(v), 0).when(v <= 0, 1).otherwise(code).cast("int")


def decode(code: Column | str, vmin: float = VMIN, vmax: float = VMAX) -> Column:
    """The decade a byte stands for; NULL for 0, which is a missing value."""
    c = column(code)
    return F.when(c > 0, F.lit(float(vmin)) + (c.cast("double") - 1.0) / 254.0 * (float(vmax) - float(vmin)))


def screened(quality: Column | str, wide: bool = False) -> Column:
    return column(quality).bitwiseAND(SCREENED_WIDE if wide else SCREENED) != 0


def flag_names(quality: Column | str) -> Column:
    """Names of the bits set, in order of bit."""
    q = column(quality)
    names = [F.when(q.bitwiseAND(bit) != 0, F.lit(name)) for name, bit in sorted(QUALITY.items(), key=lambda x: x[1])]
    return F.filter(F.array(*names), lambda x: x.isNotNull())


def overlap(r: Column | str, start: float = 30.0, full: float = 200.0, shape: float = 2.0) -> Column:
    """How much of the beam the receiver sees at range r."""
    x = (column(r) - F.lit(start)) / F.lit(full - start)
    return F.pow(F.greatest(F.least(x, F.lit(1.0)), F.lit(0.0)), F.lit(shape))


def log_value(beta: Column | str, sigma: Column | str) -> Column:
    """log10 of a value held above its noise; NULL stays NULL."""
    b = column(beta)
    return F.when(b.isNotNull(), F.log10(F.greatest(b, F.abs(column(sigma)), F.lit(1e-30))))


def log_error(beta: Column | str, sigma: Column | str, clamped: float = 0.5) -> Column:
    b, floor = column(beta), F.greatest(F.abs(column(sigma)), F.lit(1e-30))
    return F.when(b.isNull(), F.lit(None).cast("double")).when(b < floor, F.lit(clamped)).otherwise(floor / (F.when(b >= floor, b) * F.lit(2.302585092994046)))


def hex_field(text: Column | str, k: Column | int = 0) -> Column:
    """Field k of five hex digits as a 20-bit two's complement number; NULL if it is not one."""
    start = (F.lit(k) if isinstance(k, int) else k) * 5 + 1
    field = column(text).substr(start.cast("int"), F.lit(5))
    value = F.conv(F.when(field.rlike("^[0-9A-Fa-f]{5}$"), field), 16, 10).cast("long")
    return F.when(value > 524287, value - 1048576).otherwise(value)


def hex_profile(text: Column | str, gates: Column | int) -> Column:
    n = F.lit(gates) if isinstance(gates, int) else gates
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda k: hex_field(text, k)))


def hex_encode(value: Column | str) -> Column:
    return F.lpad(F.hex(column(value).bitwiseAND(1048575)), 5, "0")


def crc16(text: Column | str) -> Column:
    """CRC-16 of a string of single bytes: reflected polynomial 0x8408, start 0xFFFF, complemented."""
    codes = F.transform(F.filter(F.split(column(text), ""), lambda x: x != ""), lambda x: F.ascii(x))

    def bit(crc, _k):
        half = F.shiftrightunsigned(crc, 1)
        return F.when(crc.bitwiseAND(1) == 1, half.bitwiseXOR(F.lit(0x8408))).otherwise(half)

    def byte(crc, c):
        return F.aggregate(F.sequence(F.lit(1), F.lit(8)), crc.bitwiseXOR(c), bit)

    return F.aggregate(codes, F.lit(0xFFFF), byte).bitwiseXOR(F.lit(0xFFFF))


def array_sum(values: Column | str) -> Column:
    """Sum of the values that are there."""
    return F.aggregate(F.filter(column(values), lambda x: x.isNotNull()), F.lit(0.0), lambda s, x: s + x)


def let(value: Column, use) -> Column:
    """use(value), with value worked out once for each row, however often it is used and inside whatever lambda."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def array_mean(values: Column | str) -> Column:
    """Mean of the values that are there, NULL if there is none."""
    there = F.filter(column(values), lambda x: x.isNotNull())
    return let(there, lambda v: F.when(F.size(v) > 0, F.aggregate(v, F.lit(0.0), lambda s, x: s + x) / F.size(v)))


def array_median(values: Column | str) -> Column:
    """Median of the values that are there, NULL if there is none."""
    middle = lambda s: (F.get(s, F.floor((F.size(s) - 1) / 2).cast("int")) + F.get(s, F.floor(F.size(s) / 2).cast("int"))) / 2.0
    return let(F.array_sort(F.filter(column(values), lambda x: x.isNotNull())), lambda s: F.when(F.size(s) > 0, middle(s)))


def running_sum(values: Column | str) -> Column:
    """The sums of the values up to each place; a missing value adds nothing."""
    grown = lambda s, x: F.concat(s, F.array(F.coalesce(F.try_element_at(s, F.lit(-1)), F.lit(0.0)) + F.coalesce(x, F.lit(0.0))))
    return F.aggregate(column(values), F.array().cast("array<double>"), grown)


def smoothstep(x: Column) -> Column:
    """0 below 0, 1 above 1, a cubic with level ends between."""
    x = F.greatest(F.least(x, F.lit(1.0)), F.lit(0.0))
    return x * x * (3.0 - 2.0 * x)


def slab(r: Column, bottom: Column | None, top: Column | None, soft_bottom: Column | float = 60.0, soft_top: Column | float = 100.0) -> Column:
    """1 between two heights and 0 outside, with edges that soften over a distance; NULL or None: no edge there."""
    soft = lambda d: F.greatest((F.lit(d) if isinstance(d, float) else d) * 0.5, F.lit(1.0))
    low = F.lit(1.0) if bottom is None else F.coalesce((F.tanh((r - bottom) / soft(soft_bottom)) + 1.0) * 0.5, F.lit(1.0))
    high = F.lit(1.0) if top is None else F.coalesce((1.0 - F.tanh((r - top) / soft(soft_top))) * 0.5, F.lit(1.0))
    return low * high


def requantise(code: Column | str, vmin: float, vmax: float, lo: float, hi: float, colours: int = 256) -> Column:
    """The colour, 1 to colours - 1, of a byte of the scale vmin..vmax on the scale lo..hi; 0 stays missing."""
    c, at = column(code), (decode(code, vmin, vmax) - F.lit(float(lo))) / F.lit(max(float(hi) - float(lo), 1e-9))
    return F.when(c > 0, F.rint(F.greatest(F.least(at, F.lit(1.0)), F.lit(0.0)) * (colours - 2)) + 1).otherwise(0).cast("int")


def cumulative_depth(extinction: Column | str, spacing: float) -> Column:
    """Optical depth up to each gate."""
    return running_sum(F.transform(column(extinction), lambda a: a * spacing))


def clear_of_cloud(values: Column | str, r: Column | str, ceiling: Column | str, margin: float = 50.0) -> Column:
    """Values below a ceiling less a margin; those above are NULL. Without a ceiling all stay."""
    top = F.coalesce(column(ceiling), F.lit(float("inf"))) - margin
    return F.zip_with(column(values), column(r), lambda v, h: F.when(h < top, v))
