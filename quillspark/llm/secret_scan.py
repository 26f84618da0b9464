"""Secret scans by patterns and character Markov models (operator 10), DataFrame functions only.

The patterns give the base spans. The method looks at every other token of 20 or more key characters: two first-order Markov chains
over characters, one of random strings and one of ordinary identifiers, give it a log-likelihood ratio, and it is a
secret if the ratio is at least ``MARGIN`` in total and ``RATE`` for each character. Both chains are counted from ``SAMPLES`` labelled samples each: strings of
hash digits in the usual alphabets, and identifiers made of ordinary words in the usual cases. They have a fixed
size (64 by 64 numbers), so the model is a literal in the plan, and scoring stays on the JVM.

Offsets are code points of the whole text. Null and empty text: no spans. Repeated rows each come back; an empty table gives an empty table. Spans of equal starts are ordered by kind.
Very long texts are read whole, by one task. Other columns pass through under any name; one named like ``out_col`` is replaced.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.common import let, packed, unpacked

KINDS = ("assign", "access", "hex", "markov")
#: The base patterns. Key characters beyond the least length are asked for where a shorter match would be a whole run (access, hex).
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
TOKEN = r"[A-Za-z0-9+/_=-]{20,}"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
SAMPLES = 4000
MARGIN, RATE = 8.0, 0.2
SMOOTHING = 0.5
#: Ordinary words of identifiers, over the whole alphabet.
WORDS = [
    "account", "action", "address", "admin", "array", "async", "attribute", "balance", "base", "batch", "block", "border", "buffer", "build", "button", "byte", "cache",
    "call", "cancel", "channel", "check", "child", "class", "clean", "client", "clone", "code", "column", "command", "commit", "config", "connect", "content", "context",
    "control", "convert", "copy", "count", "create", "cursor", "customer", "data", "date", "debug", "decode", "default", "delete", "detail", "device", "dict", "disable",
    "document", "domain", "download", "driver", "edit", "element", "email", "enable", "encode", "engine", "entry", "error", "event", "exception", "execute", "export",
    "factory", "field", "file", "filter", "find", "flag", "folder", "format", "frame", "function", "generate", "graph", "group", "guard", "handle", "hash", "header",
    "height", "hidden", "host", "image", "import", "index", "info", "input", "insert", "instance", "integer", "item", "iterator", "join", "json", "key", "label",
    "language", "layout", "length", "level", "library", "limit", "line", "link", "list", "listener", "load", "local", "lock", "logger", "login", "loop", "manager", "map",
    "mask", "match", "member", "memory", "merge", "message", "method", "model", "module", "monitor", "mount", "name", "network", "next", "node", "notify", "null",
    "number", "object", "offset", "open", "option", "order", "output", "owner", "package", "page", "panel", "parent", "parse", "password", "path", "pattern", "payment",
    "pixel", "point", "policy", "port", "position", "prefix", "price", "print", "process", "product", "profile", "project", "property", "provider", "proxy", "public",
    "query", "queue", "quota", "random", "range", "record", "refresh", "region", "remote", "render", "report", "repository", "request", "reset", "resource", "response",
    "result", "role", "route", "row", "schema", "scope", "screen", "script", "search", "section", "select", "sender", "sequence", "server", "service", "session",
    "setting", "shadow", "shape", "signal", "size", "socket", "sort", "source", "stack", "start", "state", "status", "storage", "stream", "string", "style", "submit",
    "switch", "symbol", "sync", "system", "table", "target", "task", "template", "test", "text", "thread", "time", "title", "token", "topic", "total", "trace", "track",
    "transaction", "tree", "trigger", "type", "unit", "update", "upload", "user", "utility", "validate", "value", "variable", "vector", "version", "video", "view",
    "visible", "volume", "wait", "warning", "watch", "weight", "widget", "width", "window", "wizard", "worker", "wrapper", "write", "xml", "yaml", "year", "yield",
    "zero", "zone", "zoom",
]


def places(text: Column, pattern: str, group: int = 0) -> Column:
    """array<struct<start, end, own>> of a pattern's matches, ``own`` being a group of the match. Running lengths are added up in blocks of 64, so that many matches cost little."""
    extract = lambda g: F.regexp_extract_all(text, F.lit(pattern), F.lit(g))
    total = lambda a: F.aggregate(a, F.lit(0), lambda s, x: s + x)
    nothing = F.array().cast("array<int>")
    matches = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), extract(0).alias("all"), extract(group).alias("own"))  # one more gap than matches

    def spans(zipped: Column) -> Column:
        steps = F.transform(zipped, lambda x: F.length(x["gap"]) + F.coalesce(F.length(x["all"]), F.lit(0)))
        return let(steps, lambda s: let(_blocks(s), lambda b: F.transform(zipped, lambda x, i: ended(s, b, x, i))))

    def _blocks(steps: Column) -> Column:
        last = F.ceil(F.size(steps) / 64).cast("int") - 1
        return F.when(last >= 0, F.transform(F.sequence(F.lit(0), last), lambda b: total(F.slice(steps, b * 64 + 1, F.lit(64))))).otherwise(nothing)

    def ended(steps: Column, blocks: Column, x: Column, i: Column) -> Column:
        block = F.floor(i / 64).cast("int")
        end = total(F.slice(blocks, F.lit(1), block)) + total(F.slice(steps, block * 64 + 1, i % 64 + 1))
        return F.struct((end - F.length(x["all"])).alias("start"), end.alias("end"), x["own"].alias("own"))

    none = F.array().cast("array<struct<start:int,end:int,own:string>>")
    found = F.filter(let(matches, spans), lambda x: x["start"].isNotNull())
    return F.when(text.rlike(pattern), found).otherwise(none)


def _pairs(text: Column) -> Column:
    """Cells of a string's neighbouring characters in a chain's table; a character that the alphabet lacks counts as its last one."""
    known = [max(ALPHABET.find(chr(c)), -1) % len(ALPHABET) for c in range(128)]
    table = F.from_json(F.lit(json.dumps(known)), "array<int>")
    codes = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.coalesce(F.get(table, F.ascii(c)), F.lit(len(ALPHABET) - 1)))
    return let(codes, lambda k: F.transform(F.slice(k, 2, F.greatest(F.size(k), F.lit(1))), lambda c, i: F.get(k, i) * len(ALPHABET) + c))


def samples(spark: SparkSession, n: int = SAMPLES, first: int = 0, ordinary_words: list[str] = WORDS) -> DataFrame:
    """(s, random boolean): labelled samples, the same for the same range and words."""
    rows = spark.range(first, first + n)
    pick = lambda k, m: F.pmod(F.xxhash64("id", F.lit(k)), F.lit(m)).cast("int")
    digest = F.sha2(F.concat(F.lit("s"), F.col("id").cast("string")), 512)
    size = pick("size", 28) + 20
    packed = F.regexp_replace(F.base64(F.unhex(digest)), r"[\r\n=]", "")
    random = F.element_at(F.array(F.substring(packed, F.lit(1), size), F.substring(digest, F.lit(1), size), F.substring(packed, F.lit(1), size), F.upper(F.substring(packed, F.lit(1), size))), pick("form", 4) + 1)
    bank = F.from_json(F.lit(json.dumps(ordinary_words)), "array<string>")
    words = F.transform(F.sequence(F.lit(0), pick("count", 4) + 2), lambda i: F.get(bank, F.pmod(F.xxhash64(F.col("id"), i), F.lit(len(ordinary_words))).cast("int")))
    camel = F.array_join(F.transform(words, lambda w: F.initcap(w)), "")
    ordinary = F.element_at(F.array(F.array_join(words, "_"), F.array_join(words, "-"), camel, F.array_join(words, "/"), F.upper(F.array_join(words, "_")), F.array_join(words, "")), pick("case", 6) + 1)
    ordinary = F.concat(ordinary, F.when(pick("tail", 5) == 0, pick("number", 1000).cast("string")).otherwise(""))
    return rows.select(random.alias("s"), F.lit(True).alias("random")).union(rows.select(ordinary, F.lit(False)))


def log_ratios(labelled: DataFrame) -> list[float]:
    """For each pair of characters the log of its transition's probability among random strings over that among ordinary identifiers."""
    k = len(ALPHABET)
    counts = labelled.select("random", F.explode(_pairs(F.col("s"))).alias("cell")).groupBy("cell").agg(F.count_if("random").alias("r"), F.count_if(~F.col("random")).alias("o")).collect()  # at most k * k rows
    tables = {"r": [SMOOTHING] * (k * k), "o": [SMOOTHING] * (k * k)}
    for row in counts:
        for n in "ro":
            tables[n][row["cell"]] += row[n]
    rows = {n: [sum(t[i * k : (i + 1) * k]) for i in range(k)] for n, t in tables.items()}
    return [math.log(tables["r"][c] / rows["r"][c // k]) - math.log(tables["o"][c] / rows["o"][c // k]) for c in range(k * k)]


def score(text: Column, model: list[float]) -> Column:
    """The log-likelihood ratio of a string: random against ordinary."""
    table = F.from_json(F.lit(json.dumps(model)), "array<double>")
    return F.aggregate(_pairs(text), F.lit(0.0), lambda a, c: a + F.get(table, c))


def find(df: DataFrame, model: list[float], text_col: str = "text", out_col: str = "secrets") -> DataFrame:
    """``df`` with ``out_col``: array of (start, rank of kind, kind, end), by start, then kind."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    as_kind = lambda spans, k: F.transform(spans, lambda x: F.struct(x["start"].alias("start"), F.lit(k).alias("rank"), F.lit(KINDS[k]).alias("kind"), x["end"].alias("end")))
    assign = F.filter(places(text, ASSIGN, 2), lambda x: F.length(x["own"]) >= 6)
    step = df.select(packed(df), text.alias("t"), F.concat(as_kind(assign, 0), as_kind(places(text, ACCESS), 1), as_kind(places(text, HEX), 2)).alias("base"))
    clear = lambda x: ~F.exists("base", lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"]))
    drawn = lambda x: (score(x["own"], model) >= F.greatest(F.lit(MARGIN), RATE * F.length(x["own"])))
    step = step.withColumn("more", as_kind(F.filter(places(F.col("t"), TOKEN), lambda x: clear(x) & drawn(x)), 3))
    return unpacked(step, df, F.array_sort(F.concat("base", "more")), out_col)
