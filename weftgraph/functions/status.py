"""Status lines and progress prediction, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Earlier durations are trusted at first, and later while they are within this factor of those seen.
TRUST_FACTOR = 10
TRUST_UNTIL_MS = 15_000
TRUST_UNTIL_SHARE = 0.05


def format_rate(rate: Column) -> Column:
    """One decimal, or a question mark for an unknown (negative) rate."""
    return F.when(rate < 0, "?").otherwise(F.format_string("%.1f", rate))


def percent(finished: Column, total: Column) -> Column:
    return F.when((finished != 0) & (total != 0), F.floor(100 * finished / total)).otherwise(0).cast("int")


def predicted_share(total: Column, finished: Column, time_ms: Column, cpu_ms: Column, known_left: Column, known_left_ms: Column, known_all: Column, known_all_ms: Column, unknown_left: Column) -> Column:
    """Share of the work that is done: time spent over time spent and expected.

    known_*: statements with an earlier duration, left and in all, and the sum
    of those durations; unknown_left: statements left without one.
    """
    mean_now = cpu_ms / finished
    mean_then = known_all_ms / F.greatest(known_all, F.lit(1))
    far = F.greatest(mean_now, mean_then) / F.least(mean_now, mean_then)
    late = (total > 0) & (finished > 0) & (time_ms >= TRUST_UNTIL_MS) & (finished / total >= TRUST_UNTIL_SHARE)
    trusted = (known_left > 0) & (known_left_ms > 0) & (~late | F.coalesce(far < TRUST_FACTOR, F.lit(False)))
    known = finished + F.when(trusted, known_left).otherwise(0)
    unknown = F.when(trusted, unknown_left).otherwise(total - finished)
    mean = (cpu_ms + F.when(trusted, known_left_ms).otherwise(0)) / known
    expected = mean * unknown + F.when(trusted, known_left_ms).otherwise(0)
    whole = cpu_ms + expected
    return F.when((known == 0) | (whole == 0), 0.0).otherwise(cpu_ms / whole)


def _clock(seconds: Column, hours: Column) -> Column:
    t = seconds.cast("long")
    long = F.format_string("%d:%02d:%02d", F.floor(t / 3600), F.floor(t / 60) % 60, t % 60)
    return F.when(seconds < 0, "?").when(hours, long).otherwise(F.format_string("%02d:%02d", F.floor(t / 60), t % 60))


def progress_line(form: str, started: Column, total: Column, running: Column, finished: Column, time_ms: Column, rate: Column, share: Column) -> Column:
    """A status prefix: `form` with its ``%x`` fields filled."""
    overall = F.when(time_ms > 0, finished / (time_ms / 1e3)).otherwise(-1.0)
    elapsed = time_ms / 1e3
    eta = F.when(share != 0, (time_ms / share - time_ms) / 1e3).otherwise(-1.0)
    hours = (elapsed >= 3600) | (eta >= 3600)
    text = lambda c: c.cast("string")
    fields = {
        "%": lambda: F.lit("%"), "s": lambda: text(started), "t": lambda: text(total), "r": lambda: text(running), "u": lambda: text(total - started), "f": lambda: text(finished),
        "o": lambda: format_rate(overall), "c": lambda: format_rate(rate), "p": lambda: F.format_string("%3d%%", percent(finished, total)),
        "e": lambda: F.format_string("%.3f", elapsed), "w": lambda: _clock(elapsed, hours),
        "E": lambda: F.when(eta < 0, "?").otherwise(F.format_string("%.3f", eta)), "W": lambda: _clock(eta, hours),
        "P": lambda: F.format_string("%3d%%", (100 * share).cast("int")),
    }
    out, at = [], 0
    while at < len(form):
        if form[at] != "%":
            end = form.find("%", at) if "%" in form[at:] else len(form)
            out.append(F.lit(form[at:end]))
            at = end
        elif at + 1 == len(form):
            break  # a percent sign at the end says nothing
        else:
            out.append(fields[form[at + 1]]() if form[at + 1] in fields else F.lit(form[at : at + 2]))
            at += 2
    return F.concat(*out) if out else F.lit("")


def now_millis(at: Column | None = None) -> Column:
    """Milliseconds since 1970 of a time, or of the query's start."""
    return F.unix_millis(F.current_timestamp() if at is None else at)


def format_mtime(mtime: Column) -> Column:
    return mtime.cast("string")


def status_text(description: Column, command: Column, verbose: bool = False) -> Column:
    """What is shown of a statement: its description, or its command."""
    return command if verbose else F.coalesce(F.when(description != "", description), command)
