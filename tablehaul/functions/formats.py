"""Words for people: durations and progress."""


def duration(seconds: float) -> str:
    """``42s``, ``3m05s`` or ``2h03m05s``."""
    s = int(round(max(0, seconds)))
    h, m, s = s // 3600, s // 60 % 60, s % 60
    return f"{h}h{m:02}m{s:02}s" if h else f"{m}m{s:02}s" if m else f"{s}s"


def progress(done: int, total: int | None) -> str:
    """``5/20 rows (25.0%)``; without a total, the rows alone."""
    return f"{done:,}/{total:,} rows ({100 * min(done, total) / total:.1f}%)" if total else f"{done:,} rows"
