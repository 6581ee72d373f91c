"""The 75 technical indicators."""

from . import averages, oscillators, trend

__all__ = sorted(
    name
    for module in (averages, oscillators, trend)
    for name, f in vars(module).items()
    if callable(f) and getattr(f, "__module__", "") == module.__name__ and not name.startswith("_") and name != "ema_of_lane"
)
globals().update({name: getattr(module, name) for module in (averages, oscillators, trend) for name in __all__ if getattr(getattr(module, name, None), "__module__", "") == module.__name__})
