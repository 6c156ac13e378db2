"""Timeline analytics as Spark DataFrame functions.

Operators take and return DataFrames in long form, one row per beat, section, frame, chord, file or job, keyed
by a session column (``s`` by default). Nothing here collects rows to the driver, and no window or group is as
large as a session: see :mod:`metrum.plans.ordered` and :mod:`metrum.plans.fold`.
"""

from metrum.session import build_session, tune

__all__ = ["build_session", "tune"]
