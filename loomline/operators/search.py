"""Text search, similarity and repetition checks as column expressions and windows."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomline.functions.text import normalized, symbols, trimmed


def grep(rows: DataFrame, key: str, lines: str, pattern: str, context: int = 1, files: int = 300) -> DataFrame:
    """TX1: lines that match, with lines around them; touching ones are one block. At most `files` texts, in order of their key.

    `lines` is an array column. Blocks are found in the row that holds it: places near a hit, cut where one is missing.
    """
    rows = rows.withColumn("_h", F.transform(lines, lambda x: x.rlike(pattern))).filter(F.exists("_h", lambda h: h)).orderBy(key).limit(files)
    hits = F.filter(F.transform("_h", lambda h, i: F.when(h, i)), lambda i: i.isNotNull())
    # Each hit's surroundings, those that touch the ones before joined: hits ascend, so one fold over them does.
    around = F.zip_with(hits, F.array_repeat(F.size("_h") - 1, F.size(hits)), lambda i, n: F.struct(F.greatest(i - context, F.lit(0)).alias("start"), F.least(i + context, n).alias("end")))
    rows = rows.withColumn("_a", around)
    after = F.concat(F.transform(F.slice("_a", F.lit(2), F.size("_a")), lambda x: x["start"]), F.array(F.lit(1 << 30)))
    before = F.concat(F.array(F.lit(-2)), F.transform(F.slice("_a", F.lit(1), F.size("_a") - 1), lambda x: x["end"]))
    starts = F.filter(F.zip_with("_a", before, lambda x, e: F.when(x["start"] - e > 1, x["start"])), lambda p: p.isNotNull())
    ends = F.filter(F.zip_with("_a", after, lambda x, s: F.when(s - x["end"] > 1, x["end"])), lambda p: p.isNotNull())
    blocks = F.zip_with(starts, ends, lambda a, b: F.struct(a.alias("start"), b.alias("end")))
    each = rows.select(key, lines, "_h", F.explode(blocks).alias("_b")).select(key, "_b.*", F.slice(lines, F.col("_b.start") + 1, F.col("_b.end") - F.col("_b.start") + 1).alias("_l"), F.slice("_h", F.col("_b.start") + 1, F.col("_b.end") - F.col("_b.start") + 1).alias("_m"))
    return each.select(key, "start", "end", F.size(F.filter("_m", lambda h: h)).cast("long").alias("matches"), F.array_join("_l", "\n").alias("text"))


def fuzzy_find(rows: DataFrame, text: str, query: str, limit: int = 20) -> DataFrame:
    """TX2: texts that hold the query's characters in order: those with the tightest first match, then the shortest, first.

    The score is this library's own: characters matched less gaps between them, from the shortest span that the lazy pattern finds.
    """
    escaped = [c if c.isalnum() else "\\" + c for c in query.lower() if not c.isspace()]
    span = F.length(F.regexp_extract(F.lower(text), ".*?".join(escaped), 0))
    return rows.filter(F.lower(text).rlike(".*?".join(escaped))).withColumn("score", F.lit(2 * len(escaped)) - span).orderBy(F.desc("score"), F.length(text), text).limit(limit)


def symbol_similarity(rows: DataFrame, query: str, text: str) -> DataFrame:
    """TX4: Jaccard similarity of symbols to a query's, ascending, as its caller fills a budget from the end."""
    q = symbols(F.lit(query))
    both, either = F.size(F.array_intersect(symbols(F.col(text)), q)), F.size(F.array_union(symbols(F.col(text)), q))
    return rows.withColumn("score", F.coalesce(F.try_divide(both.cast("double"), either), F.lit(0.0))).orderBy("score")


def edit_similarity(a: Column, b: Column) -> Column:
    """TX5: 1 less edits by the longer length, on normalized texts; 0 if the second is empty."""
    x, y = normalized(a), normalized(b)
    return F.when(b == "", 0.0).when(x == y, 1.0).otherwise(1 - F.try_divide(F.levenshtein(x, y).cast("double"), F.greatest(F.length(x), F.length(y))))


def phrase_repeats(text: Column, size: int = 30, least: int = 3) -> Column:
    """TX12: the last `size` characters, trailing non-word ones apart, occur `least` times without overlap."""
    bare = F.regexp_replace(text, r"\W+\z", "")
    tail = F.substring(bare, -size, size)
    times = (F.length(text) - F.length(F.replace(text, tail, F.lit("")))) / size
    return F.when((F.length(text) < size * least) | (F.length(bare) < size), False).otherwise(times >= least)


def _edge(prefix: Column, suggestion: Column, suffix: Column) -> Column:
    s, p, x = trimmed(suggestion), F.regexp_replace(prefix, r"\s+\z", ""), F.regexp_replace(suffix, r"\A\s+", "")
    plain = (s == "") | F.endswith(p, s) | F.startswith(x, s)
    lines = F.split(s, "\n")
    first, last = trimmed(lines[0]), trimmed(F.element_at(lines, -1))
    before, after = trimmed(F.element_at(F.split(p, "\n"), -1)), trimmed(F.split(x, "\n")[0])
    edges = (F.size(lines) > 1) & (((first != "") & (first == before)) | ((last != "") & (last == after)))
    return plain | edges


def is_duplicate(prefix: Column, suggestion: Column, suffix: Column) -> Column:
    """TX13: a suggestion that repeats what stands around it: as a whole, by its edge lines, by its own phrases, or once its lines are completed."""
    head = F.element_at(F.split(prefix, "\n"), -1)
    tail = F.split(suffix, "\n")[0]
    whole = F.concat(head, suggestion, tail)
    above = F.substring(prefix, F.lit(1), F.length(prefix) - F.length(head))
    below = F.substring(suffix, F.length(tail) + 1, F.length(suffix))
    partial = (head != "") | (tail != "")
    return _edge(prefix, suggestion, suffix) | phrase_repeats(suggestion) | (partial & _edge(above, whole, below))


def postprocessed(prefix: Column, suggestion: Column, suffix: Column, extreme: Column | None = None) -> Column:
    """TX14: NULL for blank suggestions, extreme repetition and duplicates; else the suggestion without fences and a doubled leading space."""
    bare = F.regexp_replace(F.regexp_replace(suggestion, r"\A```\w*\n", ""), r"\n?```\s*\z", "")
    out = F.when(F.endswith(prefix, F.lit(" ")) & F.startswith(bare, F.lit(" ")), F.substring(bare, F.lit(2), F.length(bare))).otherwise(bare)
    bad = (trimmed(suggestion) == "") | is_duplicate(prefix, suggestion, suffix)
    if extreme is not None:
        bad = bad | extreme
    return F.when(~bad, out)


def skip_completion(language: Column, prefix: Column, terminators: dict[str, list[str]], default: list[str] = (";", "}", ")")) -> Column:
    """XS10: no completion after the end of a statement in the language, nor inside a word."""
    line = F.regexp_replace(F.element_at(F.split(prefix, "\n"), -1), r"\s+\z", "")
    ends = lambda marks: F.array_contains(F.transform(F.array(*map(F.lit, marks)), lambda m: F.endswith(line, m)), True)
    known = F.lit(False)
    out = ends(default)
    for name, marks in terminators.items():
        out = F.when(language == name, ends(marks) if marks else known).otherwise(out)
    return (line != "") & (out | prefix.rlike(r"\w\z"))


# Files that package managers write to pin versions, and folders of theirs, wherever they are.
LOCK_FILES = (
    "package-lock.json", "npm-shrinkwrap.json", "yarn.lock", "pnpm-lock.yaml", "pnpm-workspace.yaml", "bun.lockb", ".yarnrc.yml", ".pnp.js", ".pnp.cjs", "jspm.lock",
    "Pipfile.lock", "poetry.lock", "pdm.lock", ".pdm-lock.toml", "conda-lock.yml", "pylock.toml", "Gemfile.lock", ".bundle/config", "composer.lock",
    "gradle.lockfile", "lockfile.json", "dependency-lock.json", "dependency-reduced-pom.xml", "coursier.lock", "build.sbt.lock", "packages.lock.json", "paket.lock", "project.assets.json",
    "Cargo.lock", "go.sum", "Gopkg.lock", "glide.lock", "vendor/vendor.json", "build.zig.zon.lock", "dune.lock", "opam.lock", "kotlin-js-store",
    "Package.resolved", "Podfile.lock", "Cartfile.resolved", "pubspec.lock", "mix.lock", "rebar.lock", "stack.yaml.lock", "cabal.project.freeze", "elm-stuff/exact-dependencies.json",
    "shard.lock", "Manifest.toml", "JuliaManifest.toml", "renv.lock", "packrat.lock", "nimble.lock", "dub.selections.json", "rocks.lock", "carton.lock", "cpanfile.snapshot",
    "conan.lock", "vcpkg-lock.json", ".terraform.lock.hcl", "Berksfile.lock", "Puppetfile.lock", "flake.lock", "deno.lock", "devcontainer.lock.json",
)
LOCK_FOLDERS = ("kotlin-js-store", "elm-stuff", ".yarn/cache/", ".yarn/unplugged/", ".yarn/build-state.yml", ".yarn/install-state.gz")


def is_lock_file(path: Column, patterns: Iterable[str] | None = None) -> Column:
    """XS21: a lock file by its name or folder; or any of the given patterns matches."""
    if patterns is None:
        patterns = [r"(?:^|/)(?:" + "|".join(re.escape(x) for x in (*LOCK_FILES, *(f for f in LOCK_FOLDERS if not f.endswith("/")))) + r")(?:/|$)", r"(?:^|/)(?:" + "|".join(re.escape(f) for f in LOCK_FOLDERS if f.endswith("/")) + ")."]
    return F.replace(path, F.lit("\\"), F.lit("/")).rlike("|".join(f"(?:{p})" for p in patterns))


def glossary(texts: DataFrame, text: str, core: list[str], limit: int = 50, least: int = 4) -> DataFrame:
    """XS11: core terms, then the longest identifiers of the texts in what slots are left."""
    words = texts.select(F.explode(F.regexp_extract_all(text, F.lit(rf"(?<![A-Za-z0-9_])[A-Za-z_][A-Za-z0-9_]{{{least - 1},}}(?![A-Za-z0-9_])"), 0)).alias("term")).distinct().filter(~F.col("term").isin(core) if core else F.lit(True))
    slots = max(0, limit - len(core))
    return words.orderBy(F.desc(F.length("term")), "term").limit(slots)


def problems(diagnostics: DataFrame, severities: list[int], most: int, file: str = "file", line: str = "line", severity: str = "severity", tie: list[str] = ()) -> DataFrame:
    """XS2: the first `most` by severity and line over all files, then per file by line; with how many were left out."""
    rows = diagnostics.filter(F.col(severity).isin(severities))
    total = rows.agg(F.count(F.lit(1)).alias("_t"))
    picked = rows.orderBy(severity, line, *tie).limit(most)
    return picked.crossJoin(F.broadcast(total)).withColumn("omitted", F.greatest(F.col("_t") - most, F.lit(0))).drop("_t").orderBy(file, line)


def catalog_page(models: DataFrame, search: str, fields: list[str], price: list[str], sort: list[Column], deprecated: str | None = None) -> DataFrame:
    """XS1: models that aren't deprecated and match in any field, with their total price."""
    rows = models.filter(~F.coalesce(F.col(deprecated), F.lit(False))) if deprecated else models
    if search:
        hit = F.lit(False)
        for f in fields:
            hit = hit | F.lower(f).contains(search.lower())
        rows = rows.filter(hit)
    total = F.lit(0.0)
    for p in price:
        total = total + F.coalesce(F.col(p), F.lit(0.0))
    return rows.withColumn("total_price", total).orderBy(*sort)


def prefix_counts(rows: DataFrame, name: str, mark: str = "-") -> DataFrame:
    """XS3: rows by their name's part before a mark."""
    return rows.groupBy(F.substring_index(name, mark, 1).alias("prefix")).agg(F.count(F.lit(1)).alias("n"))


def level_counts(rows: DataFrame, level: str, levels: list[str]) -> DataFrame:
    """XS14: counts by level, 0 for levels that don't occur."""
    spark = rows.sparkSession
    every = spark.createDataFrame([(x,) for x in levels], f"{level} string")
    return every.join(rows.groupBy(level).agg(F.count(F.lit(1)).alias("_n")), level, "left").select(level, F.coalesce("_n", F.lit(0)).alias("n"))


def grouped(rows: DataFrame, by: str, value: str) -> DataFrame:
    """XS15: values of each section, in order."""
    return rows.groupBy(by).agg(F.array_sort(F.collect_list(value)).alias("results"))


def rate_limit(used_percent: Column, reset_seconds: Column, window_minutes: Column) -> Column:
    """XS17: clamped percentage, reset in milliseconds and window of a usage window; NULL if nothing is known."""
    percent = F.greatest(F.lit(0.0), F.least(F.lit(100.0), used_percent.cast("double")))
    return F.when(used_percent.isNotNull(), F.struct(percent.alias("percent"), F.round(reset_seconds * 1000).cast("long").alias("reset_ms"), window_minutes.alias("window")))


def highlighted_levels(line: Column, patterns: dict[str, str]) -> Column:
    """FL15: the level whose pattern matches earliest in the line; of equal starts the first listed; NULL if none does."""
    found = F.array(*[F.struct(F.length(F.regexp_extract(line, rf"(?s)\A(.*?)(?:{p})", 1)).alias("at"), F.lit(i).alias("i"), F.lit(name).alias("level"), line.rlike(p).alias("hit")) for i, (name, p) in enumerate(patterns.items())])
    return F.array_min(F.filter(found, lambda x: x["hit"]))["level"]
