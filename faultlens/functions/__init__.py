"""Column-expression helpers (scalar functions). All JVM-side, no UDFs."""
from faultlens.functions.text import py_strip, tokens, hot_cold_key  # noqa: F401
from faultlens.functions.time import epoch_micros, epoch_nanos, from_epoch_micros, ts_text_ms, ts_text_s  # noqa: F401
