"""Quality rules with verdicts on hosts, in DataFrame operations alone.

Each document is judged by rules on its own text. Failures are summed by host
(the source), host failure rates are shrunk towards the corpus by a beta prior
whose mean and strength come from all hosts (method of moments), and hosts
whose shrunk rate is above a limit are rejected with all their documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import stored

SPACE = r"[\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = r"[#*$%&|<>]"
#: A host is rejected when its shrunk rate of failures is above this.
HOST_LIMIT = 0.8
#: Limits on the strength of the prior, in documents.
LEAST_STRENGTH, MOST_STRENGTH = 1.0, 1_000_000.0
MIN_WORDS, REPEATED_PERCENT = 50, 50
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def words(text: Column) -> Column:
    """Words [^\\x20\\x09-\\x0D]+ of a text that isn't null."""
    trimmed = F.btrim(text, F.lit(SPACES))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE, -1))


def counted(docs: DataFrame, name: str) -> DataFrame:
    """docs with a struct column of that name: COUNTS and base_failed.

    A repeated 3-word window is found by sorting longs that hold a window's
    hash in the high bits and its place in as many low bits as the text needs:
    windows with one hash become neighbours. Those that have such a neighbour
    are sorted again by all 64 bits, since the longs of long texts hold few; the
    places of those that still have one give the words that are covered.
    """
    w, s, m, d, b = (f"{name}_{x}" for x in ("w", "s", "m", "d", "b"))
    text = F.coalesce(F.col("text"), F.lit(""))
    out = docs.withColumn(w, words(text))
    n = F.size(w)
    out = out.withColumn(b, F.when(n < 1024, F.lit(1023)).when(n < 32768, F.lit(32767)).when(n < (1 << 20), F.lit((1 << 20) - 1)).otherwise(F.lit((1 << 31) - 1)).cast("long"))
    window = lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))
    packed = F.transform(F.sequence(F.lit(0), n - 3), lambda i: window(i).bitwiseAND(F.bitwise_not(F.col(b))).bitwiseOR(i.cast("long")))
    out = out.withColumn(s, F.when(n < 3, F.array().cast("array<bigint>")).otherwise(F.sort_array(packed)))
    alike = lambda x, y: F.coalesce(x.bitwiseXOR(y).between(F.lit(0), F.col(b)), F.lit(False))
    maybe = F.filter(s, lambda x, i: alike(x, F.get(s, i + 1)) | alike(x, F.get(s, i - 1)))
    place = lambda x: x.bitwiseAND(F.col(b)).cast("int")
    out = out.withColumn(m, F.sort_array(F.transform(maybe, lambda x: F.struct(window(place(x)).alias("h"), place(x).alias("p")))))
    same = lambda x, y: F.coalesce(x["h"] == y["h"], F.lit(False))
    repeats = F.filter(m, lambda x, i: same(x, F.get(m, i + 1)) | same(x, F.get(m, i - 1)))
    out = out.withColumn(d, F.sort_array(F.transform(repeats, lambda x: x["p"].cast("long"))))
    covered = F.aggregate(F.transform(d, lambda p, i: F.coalesce(F.least(F.get(d, i + 1) - p, F.lit(3)), F.lit(3)).cast("long")), F.lit(0).cast("long"), lambda a, x: a + x)
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    out = out.withColumn(f"{name}_l", lines)
    found = {
        "n_words": n.cast("long"),
        "word_chars": F.length(F.array_join(w, "")).cast("long"),
        "n_symbols": (F.length(text) - F.length(F.regexp_replace(text, SYMBOLS, ""))).cast("long"),
        "n_dup_lines": (F.size(f"{name}_l") - F.size(F.array_distinct(f"{name}_l"))).cast("long"),
        "n_repeat_words": covered,
    }
    failed = (found["n_words"] < MIN_WORDS) | (100 * covered > REPEATED_PERCENT * found["n_words"])
    out = out.withColumn(name, F.struct(*(c.alias(k) for k, c in found.items()), failed.alias("base_failed")))
    return out.drop(w, s, m, d, b, f"{name}_l")


def host_verdicts(rows: DataFrame, host: str, failed: str) -> DataFrame:
    """(host, host_docs, host_failed, host_rate, host_kept) by shrunk rates; a null host counts as an empty one.

    Only sums by host are shuffled; of the prior two numbers come to the driver.
    """
    hosts = stored(rows.groupBy(F.coalesce(F.col(host), F.lit("")).alias("host")).agg(F.count("*").alias("host_docs"), F.count_if(F.col(failed)).alias("host_failed")))
    rate = F.col("host_failed") / F.col("host_docs")
    x = hosts.agg((F.sum("host_failed") / F.sum("host_docs")).alias("mean"), F.var_pop(rate).alias("var")).first()
    mean, var = x.mean or 0.0, x["var"] or 0.0
    strength = min(MOST_STRENGTH, max(LEAST_STRENGTH, mean * (1 - mean) / var - 1)) if var > 0 else MOST_STRENGTH if mean in (0.0, 1.0) else LEAST_STRENGTH
    shrunk = (F.col("host_failed") + F.lit(mean * strength)) / (F.col("host_docs") + F.lit(strength))
    return hosts.withColumn("host_rate", shrunk).withColumn("host_kept", F.col("host_rate") <= HOST_LIMIT)


def quality(docs: DataFrame, host: str = "source") -> DataFrame:
    """doc_id, COUNTS, base_failed, host, host_rate, kept for each row of docs (doc_id, text, host).

    kept is false where the document fails a rule or its host is rejected. A
    null or empty text has no words and fails; repeated rows give repeated
    rows and count each; an empty table gives none; other columns are ignored.
    """
    rows = stored(counted(docs.select("doc_id", "text", F.coalesce(F.col(host), F.lit("")).alias("host")), "q").select("doc_id", "host", "q.*"))
    verdicts = host_verdicts(rows, "host", "base_failed")
    out = rows.join(verdicts.select("host", "host_rate", "host_kept"), "host", "left")
    return out.select("doc_id", *COUNTS, "base_failed", "host", "host_rate", (~F.col("base_failed") & F.col("host_kept")).alias("kept"))


def quality_kept(docs: DataFrame, host: str = "source") -> DataFrame:
    """The rows of docs that quality() keeps, with the columns of docs, whatever their names."""
    name = "_q"
    while any(c.startswith(name) for c in docs.columns):
        name = "_" + name
    rows = stored(counted(docs, name).withColumn(f"{name}h", F.coalesce(F.col(host), F.lit(""))))
    verdicts = host_verdicts(rows.select(F.col(f"{name}h").alias("h"), F.col(name).getField("base_failed").alias("f")), "h", "f")
    good = verdicts.where("host_kept").select(F.col("host").alias(f"{name}h"))
    return rows.where(~F.col(name).getField("base_failed")).join(good, f"{name}h", "left_semi").select(*docs.columns)


ORACLE = r"""
with d as (
  select doc_id, source, text,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) l
  from documents),
e as (
  select doc_id, source, len(w) n_words, coalesce(length(array_to_string(w, '')), 0) word_chars,
    length(coalesce(text, '')) - length(regexp_replace(coalesce(text, ''), '[#*$%&|<>]', '', 'g')) n_symbols,
    len(l) - len(list_distinct(l)) n_dup_lines,
    list_transform(range(0, greatest(len(w) - 2, 0)), lambda i: w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3]) t,
    row_number() over () r
  from d),
u as (select r, unnest(t) x, generate_subscripts(t, 1) i from e),
m as (select r, i, count(*) over (partition by r, x) n from u),
c as (select r, count(distinct p) n_repeat_words from (select r, unnest([i, i + 1, i + 2]) p from m where n > 1) group by r),
f as (
  select e.*, coalesce(n_repeat_words, 0) n_repeat_words,
    n_words < 50 or 100 * coalesce(n_repeat_words, 0) > 50 * n_words base_failed
  from e left join c using (r)),
h as (select coalesce(source, '') host, count(*) n, count(*) filter (base_failed) k from f group by 1),
p as (select sum(k) / sum(n) mean, var_pop(k / n) v from h),
s as (
  select mean, case when v > 0 then least(1e6, greatest(1.0, mean * (1 - mean) / v - 1)) when mean in (0, 1) then 1e6 else 1.0 end strength
  from p),
g as (select host, (k + mean * strength) / (n + strength) <= 0.8 host_kept from h, s)
select doc_id, n_words::bigint n_words, word_chars::bigint word_chars, n_symbols::bigint n_symbols, n_dup_lines::bigint n_dup_lines,
  n_repeat_words::bigint n_repeat_words, base_failed, (not base_failed) and host_kept kept
from f join g on g.host = coalesce(f.source, '')
"""
