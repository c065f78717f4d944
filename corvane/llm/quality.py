"""Quality rules of documents and of their hosts.

Each document is measured and held against rules. Failures are counted by host; a host's failure rate is shrunk towards
a beta prior that is fitted to all hosts by the method of moments, so that a host with few documents is not judged by
them alone. Two verdicts go back to the documents of a host:

* rejected: the shrunk rate of a rule reaches its threshold; all its documents go;
* flagged: the host's rate exceeds the prior's mean by a quarter with a posterior probability of nine tenths; of its
  documents only those stay that pass every rule, while elsewhere the base rules suffice.

Where hosts differ by no more than chance, the fitted prior is so strong that no host is flagged.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, per_text

SPACES = b" \t\n\r\x0b\x0c"
SYMBOLS = b"#*$%&|<>"
WINDOW = 5
#: Shares from which a document fails a rule: symbols of words, duplicate lines of lines; mean word lengths that pass.
SYMBOL_SHARE, DUP_LINE_SHARE, WORD_LENGTH = 0.1, 0.3, (3, 10)
#: Shrunk failure rate from which a host is rejected, by rule.
THRESHOLDS = {"few_words": 0.6, "repeats": 0.5, "symbols": 0.6, "dup_lines": 0.6, "word_length": 0.6}
#: A host is flagged if its rate is over EXCESS times the prior's mean with a probability of 0.9 (its normal quantile).
EXCESS, QUANTILE = 1.25, 1.2816
#: Documents that the prior stands for at least, so that no host is judged by a few of its own.
LEAST_STRENGTH = 10.0
#: Up to so many hosts, verdicts are broadcast (at most about 16 MB); beyond, both sides are dealt out by host and salt.
BROADCAST_HOSTS = 100_000
SALTS = 32


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words that lie in a window found twice or more."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    if len(number) == len(words):
        return 0
    if len(number) <= 4096 and window <= 5:
        keys = ids[:n].copy()
        for k in range(1, window):
            keys = (keys << 12) | ids[k : k + n]
    else:  # exact as well: a run of words becomes the number of its (shorter run, next word)
        keys = ids[:n]
        for k in range(1, window):
            keys = np.unique(keys * len(number) + ids[k : k + n], return_inverse=True)[1].astype(np.int64)
    order = np.argsort(keys, kind="stable")
    same = keys[order[1:]] == keys[order[:-1]]
    if not same.any():
        return 0
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    inside = np.zeros(len(words), bool)
    for k in range(window):
        inside[k : k + n] |= twice
    return int(inside.sum())


MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")


def measure(texts: list[bytes]) -> dict[str, list]:
    """Counts of each text."""
    out: dict[str, list] = {k: [] for k in MEASURES}
    for text in texts:
        words = text.split()
        lines = [x for x in text.split(b"\n") if x.strip(SPACES)]
        out["n_words"].append(len(words))
        out["word_chars"].append(len(text.translate(None, SPACES).decode(errors="replace")))
        out["n_symbols"].append(len(text) - len(text.translate(None, SYMBOLS)))
        out["n_dup_lines"].append(len(lines) - len(set(lines)))
        out["n_repeat_words"].append(repeated_words(words))
        out["n_lines"].append(len(lines))
    return out


def failures() -> dict[str, F.Column]:
    """The rules, as conditions on the measures; the first two are the base."""
    least, most = WORD_LENGTH
    return {
        "few_words": F.col("n_words") < 10,
        "repeats": 100 * F.col("n_repeat_words") > 20 * F.col("n_words"),
        "symbols": F.col("n_symbols") > F.lit(SYMBOL_SHARE) * F.col("n_words"),
        "dup_lines": F.col("n_dup_lines") > F.lit(DUP_LINE_SHARE) * F.col("n_lines"),
        "word_length": (F.col("word_chars") < least * F.col("n_words")) | (F.col("word_chars") > most * F.col("n_words")),
    }


def host_verdicts(measured: DataFrame, host: str = "host", thresholds: dict[str, float] | None = None) -> tuple[DataFrame, int]:
    """(a row for each host: its counts, shrunk rates, ``host_ok`` and ``host_flags``, number of hosts).

    The prior of a rule: mean m = failures / documents; between-host variance v = variance of the hosts' rates less the
    mean sampling variance m(1-m)/n; strength s = m(1-m)/v - 1, held within [10, 10^6] documents; beta(m s, (1-m) s).
    The posterior's mean is the shrunk rate p, its variance p(1-p)/(n+s+1). One row of sums reaches the driver. Rows
    without a host are not judged.
    """
    thresholds = THRESHOLDS | (thresholds or {})
    rules = failures()
    hosts = measured.where(F.col(host).isNotNull()).groupBy(host).agg(F.count(F.lit(1)).alias("n"), *[F.sum(c.cast("long")).alias(f"k_{r}") for r, c in rules.items()])
    hosts = cut(hosts)
    sums = hosts.agg(
        F.count(F.lit(1)).alias("hosts"), F.sum("n").alias("n"), F.sum(1 / F.col("n")).alias("inverse"), *[F.sum(f"k_{r}").alias(f"k_{r}") for r in rules], *[F.var_pop(F.col(f"k_{r}") / F.col("n")).alias(f"v_{r}") for r in rules]
    ).first()
    out, verdict, flags = hosts, F.lit(True), []
    for r in rules:
        m = (sums[f"k_{r}"] or 0) / sums["n"] if sums["n"] else 0.0
        within = m * (1 - m) * (sums["inverse"] or 0) / max(sums["hosts"], 1)
        between = max((sums[f"v_{r}"] or 0.0) - within, 1e-12)
        strength = min(max(m * (1 - m) / between - 1, LEAST_STRENGTH), 1e6)
        rate = F.col(f"rate_{r}")
        out = out.withColumn(f"rate_{r}", (F.col(f"k_{r}") + F.lit(m * strength)) / (F.col("n") + F.lit(strength)))
        verdict = verdict & (rate < F.lit(float(thresholds[r])))
        flags.append(F.when(rate - F.lit(EXCESS * m) >= F.lit(QUANTILE) * F.sqrt(rate * (1 - rate) / (F.col("n") + F.lit(strength + 1))), F.when(rate > 0, F.lit(r))))
    return out.withColumn("host_ok", verdict).withColumn("host_flags", F.concat_ws(",", *flags)), sums["hosts"]


def host_rules(docs: DataFrame, host: str = "source", keep: tuple[str, ...] = ("doc_id",), thresholds: dict[str, float] | None = None) -> DataFrame:
    """Measure each row's ``text``, judge it and its host.

    Adds the measures, base_failed (fewer than 10 words, or over a fifth of them in repeated windows), rule_failed (any
    rule), host_ok (not rejected), host_flags (names of rules for which the host is flagged, comma-joined), the host's
    shrunk rate of each rule and kept: not base_failed, host_ok, and no rule failed at a flagged host. A null text has no
    words; a null host is not judged (host_ok is true, no flags, null rates); repeated rows count as often as they stand
    there; an empty table gives an empty result; columns other than ``keep``, the host and the text are ignored.
    Measures are written once to the shared folder; failures are summed by host before they are shuffled; verdicts are
    broadcast up to BROADCAST_HOSTS hosts (counted first) and joined by host and salt beyond. Building the frame runs
    these jobs.
    """
    rows = docs.select(*keep, F.col(host).cast("string").alias("__host"), "text")
    fields = [(k, pa.int64()) for k in MEASURES]
    measured = cut(per_text(rows, [*keep, "__host"], lambda: measure, fields, ", ".join(f"{k} long" for k, _ in fields)))
    verdicts, hosts = host_verdicts(measured, "__host", thresholds)
    rules = failures()
    verdicts = verdicts.select("__host", F.struct("host_ok", "host_flags", *[F.round(f"rate_{r}", 9).alias(f"rate_{r}") for r in rules]).alias("__verdict"))
    if hosts <= BROADCAST_HOSTS:
        joined = measured.join(F.broadcast(verdicts), "__host", "left")
    else:
        salted = measured.withColumn("__salt", F.pmod(F.xxhash64(*keep), F.lit(SALTS)))
        joined = salted.join(verdicts.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["__host", "__salt"], "left")
    failed = rules["few_words"]
    for r in list(rules)[1:]:
        failed = failed | rules[r]
    base = rules["few_words"] | rules["repeats"]
    ok, flags = F.coalesce("__verdict.host_ok", F.lit(True)), F.coalesce("__verdict.host_flags", F.lit(""))
    return joined.select(
        *keep,
        *MEASURES,
        base.alias("base_failed"),
        failed.alias("rule_failed"),
        ok.alias("host_ok"),
        flags.alias("host_flags"),
        *[F.col(f"__verdict.rate_{r}").alias(f"rate_{r}") for r in rules],
        (~base & ok & ~(failed & (flags != ""))).alias("kept"),
    )
