"""Column expressions over quotes, symbols and bars."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F

# Code prefixes of listed shares, and of the boards with the wide daily limit.
SHARE_PREFIXES = ("000", "001", "002", "003", "300", "301", "600", "601", "603", "605", "688", "689")
WIDE_BOARDS = ("688", "300", "301")
EPSILON = 1e-8


def clean(c: Column, kind: str = "double") -> Column:
    """NULL and NaN become 0."""
    return F.coalesce(F.nanvl(c.cast("double"), F.lit(0.0)), F.lit(0.0)).cast(kind)


def is_share(symbol: Column) -> Column:
    """Whether the code before the dot has six characters and a listed prefix."""
    code = F.split_part(symbol, F.lit("."), F.lit(1))
    return (F.length(code) == 6) & F.substring(code, 1, 3).isin(*SHARE_PREFIXES)


def daily_limit_bp(symbol: Column) -> Column:
    return F.when(F.substring(symbol, 1, 3).isin(*WIDE_BOARDS), F.lit(2000)).otherwise(F.lit(1000))


def is_locked(bid: Column, ask: Column, threshold: float = 0.001) -> Column:
    """A side is missing, or the spread is under the threshold of the bid."""
    return (bid <= 0) | (ask <= 0) | (F.abs(ask - bid) / F.greatest(bid, F.lit(EPSILON)) < threshold)


def pack_book(levels: int = 10, prefixes: tuple[str, ...] = ("bid_p", "bid_v", "ask_p", "ask_v")) -> Column:
    """The level columns as an array of structs."""
    return F.array(*[F.struct(*[F.col(f"{p}{i}").cast("float").alias(p) for p in prefixes]) for i in range(1, levels + 1)])


def sum_across(columns: list[Column]) -> Column:
    return reduce(add, columns)


def side_depth(prefix: str, levels: int = 10) -> Column:
    return sum_across([F.col(f"{prefix}{i}") for i in range(1, levels + 1)])


def imbalance(bids: Column, asks: Column) -> Column:
    return (bids - asks) / (bids + asks + EPSILON)


def micro_price(bid: Column, ask: Column, bids: Column, asks: Column) -> Column:
    return (bid * asks + ask * bids) / (bids + asks + EPSILON)


def log_depth(bids: Column, asks: Column) -> Column:
    return F.log1p(bids + asks)


def mid_price(bid: Column, ask: Column) -> Column:
    return F.greatest((bid + ask) / 2, F.lit(1e-6))


def deviation_bp(price: Column, mid: Column) -> Column:
    return (price - mid) / mid * 10000


def log_return(close: Column, first: Column) -> Column:
    """Hundredfold log return against the first bar."""
    return F.log(F.greatest(close, F.lit(1e-6)) / F.greatest(first, F.lit(1e-6))) * 100


def log_volume(v: Column) -> Column:
    return F.log1p(F.greatest(v, F.lit(0.0)))


def log_modulus(x: Column) -> Column:
    return F.signum(x) * F.log1p(F.abs(x))


def symlog(x: Column, most: float | None = 1e12) -> Column:
    """log_modulus of x, within +-most if given."""
    return log_modulus(F.least(F.greatest(x, F.lit(-most)), F.lit(most)) if most else x)


def level_features(level: Column) -> list[Column]:
    """Deviation of the bid, log bid volume, deviation of the ask, log ask volume."""
    bid, ask, bids, asks = (level[x].cast("double") for x in ("bid_p", "ask_p", "bid_v", "ask_v"))
    mid = mid_price(bid, ask)
    return [deviation_bp(bid, mid), log_volume(bids), deviation_bp(ask, mid), log_volume(asks)]


def bar_features(close: Column, first: Column, quantity: Column, macro: Iterable[Column] = ()) -> list[Column]:
    """Log return against the window's first bar and symlog quantity; with macro, the logs of these after them."""
    return [log_return(close, first), symlog(quantity), *(log_volume(m) for m in macro)]


def manifold(bars: Column, levels: str = "lob", close: str = "close", quantity: str = "q_hat", macro: tuple[str, ...] = ()) -> Column:
    """Per bar of a window and level of its book: level_features and bar_features. `clock.flat_manifold` gives the same as rows, without arrays of windows."""
    first = F.get(bars, F.lit(0))[close]
    shared = lambda bar: F.array(*bar_features(bar[close], first, bar[quantity], [bar[m] for m in macro]))
    once = F.transform(bars, lambda bar: F.struct(bar[levels].alias("levels"), shared(bar).alias("shared")))
    return F.transform(once, lambda bar: F.transform(bar["levels"], lambda level: F.concat(F.array(*level_features(level)), bar["shared"])))


def implied_quantity(delta_p: Column, sigma: Column, volume: Column, friction: Column) -> Column:
    """The signed quantity that the square-root law implies for a price move."""
    return F.signum(delta_p) * F.pow(F.abs(delta_p) / (friction * sigma + EPSILON), 2) * (volume + EPSILON)


def sample_key(symbol: Column, index: Column) -> Column:
    """600519.SH, 42 -> 600519_SH_000000042."""
    return F.concat_ws("_", F.replace(symbol, F.lit("."), F.lit("_")), F.lpad(index.cast("string"), 9, "0"))


KEY_PATTERN = r"^([^_]+)_([A-Za-z]{1,3})_(\d+)$"


def key_symbol(key: Column) -> Column:
    """The symbol of a sample key; a key of another form is its own symbol."""
    return F.when(key.rlike(KEY_PATTERN), F.concat_ws(".", F.regexp_extract(key, KEY_PATTERN, 1), F.regexp_extract(key, KEY_PATTERN, 2))).otherwise(key)


def key_index(key: Column) -> Column:
    return F.when(key.rlike(KEY_PATTERN), F.regexp_extract(key, KEY_PATTERN, 3).cast("long"))


def date_of_file(name: Column) -> Column:
    """The date that a file name starts with (yyyyMMdd); NULL if it doesn't."""
    return F.try_to_timestamp(F.substring(name, 1, 8), F.lit("yyyyMMdd")).cast("date")


def date_or_time_prefix(date: Column, time: Column) -> Column:
    return F.coalesce(date, F.substring(time.cast("string"), 1, 10))


def is_bad_number(x: Column) -> Column:
    return F.isnan(x) | (F.abs(x) == float("inf"))


def pooled(windows: Column) -> Column:
    """Elementwise maximum over an array of equal-length arrays."""
    return F.aggregate(F.slice(windows, 2, F.greatest(F.size(windows) - 1, F.lit(0))), F.get(windows, F.lit(0)), lambda acc, w: F.zip_with(acc, w, lambda a, b: F.greatest(a, b)))


def coarse(values: Column, k: int) -> Column:
    """Means over non-overlapping groups of k; the remainder is dropped."""
    groups = F.floor(F.size(values) / k).cast("int")
    mean = lambda g: F.aggregate(F.slice(values, g * k + 1, F.lit(k)), F.lit(0.0), lambda a, x: a + x.cast("double")) / k
    return F.when(groups > 0, F.transform(F.sequence(F.lit(0), groups - 1), mean)).otherwise(F.array().cast("array<double>"))


def last_bars(bars: Column, n: int) -> Column:
    return F.when(F.size(bars) >= n, F.slice(bars, -n, n)).otherwise(bars)


# The channels of a sample's tensor; two are reserved and zero.
CHANNELS = ("bid_p", "bid_v", "ask_p", "ask_v", "close", None, None, "delta_p", "v_d", "sigma_d")


def sample_tensor(bars: Column, levels: str = "lob") -> Column:
    """Bars (with a book, close, delta_p, v_d and sigma_d) as a tensor: by bar, level and channel."""
    side = ("bid_p", "bid_v", "ask_p", "ask_v")
    of_level = lambda bar, level: F.array(*[F.lit(0.0).cast("float") if c is None else (level if c in side else bar)[c].cast("float") for c in CHANNELS])
    return F.transform(bars, lambda bar: F.transform(bar[levels], lambda level: of_level(bar, level)))


def last_quote(tensor: Column) -> Column:
    """bid_p1, ask_p1 and macro_v_d of a tensor's last bar, at the first level."""
    channel = lambda name: F.get(F.get(F.element_at(tensor, -1), F.lit(0)), F.lit(CHANNELS.index(name))).cast("double")
    return F.struct(channel("bid_p").alias("bid_p1"), channel("ask_p").alias("ask_p1"), channel("v_d").alias("macro_v_d"))
