"""Lines of code: counts by language, deltas, patches, lines written by tools."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import lines

# Languages by file extension and name, and how their comment lines start.
LANGUAGES = {".bash": "Shell", ".c": "C", ".cfg": "Config", ".conf": "Config", ".cpp": "C++", ".cs": "C#", ".css": "CSS", ".go": "Go", ".h": "C/C++ Header", ".hpp": "C/C++ Header", ".html": "HTML", ".ini": "Config", ".java": "Java", ".js": "JavaScript", ".json": "JSON", ".jsx": "JavaScript", ".kt": "Kotlin", ".kts": "Kotlin", ".less": "CSS", ".lua": "Lua", ".md": "Markdown", ".php": "PHP", ".ps1": "PowerShell", ".py": "Python", ".rb": "Ruby", ".rs": "Rust", ".sass": "CSS", ".scala": "Scala", ".scss": "CSS", ".sh": "Shell", ".sql": "SQL", ".swift": "Swift", ".toml": "TOML", ".ts": "TypeScript", ".tsx": "TypeScript", ".vue": "Vue", ".yaml": "YAML", ".yml": "YAML", ".zsh": "Shell"}
FILE_NAMES = {".dockerignore": "Docker", ".env.example": "Config", ".gitignore": "Config", "Dockerfile": "Docker", "Makefile": "Make"}
SLASHES = ["//", "/*", "*"]
COMMENTS = {"C": SLASHES, "C#": SLASHES, "C++": SLASHES, "C/C++ Header": SLASHES, "CSS": ["/*", "*"], "Config": ["#", ";"], "Docker": ["#"], "Go": SLASHES, "HTML": ["<!--"], "Java": SLASHES, "JavaScript": SLASHES, "Kotlin": SLASHES, "Lua": ["--"], "Make": ["#"], "Markdown": ["<!--"], "PHP": ["//", "#", "/*", "*"], "PowerShell": ["#"], "Python": ["#"], "Ruby": ["#"], "Rust": SLASHES, "Scala": SLASHES, "Shell": ["#"], "SQL": ["--"], "Swift": SLASHES, "TOML": ["#"], "TypeScript": SLASHES, "Vue": ["<!--", *SLASHES], "YAML": ["#"]}
# Folders and endings of files that don't count.
SKIPPED = [".eggs", ".git", ".hg", ".mypy_cache", ".nox", ".pytest_cache", ".ruff_cache", ".svn", ".tox", ".venv", "__pycache__", "build", "dist", "env", "node_modules", "site-packages", "venv"]
SKIPPED_ENDINGS = [".lock", ".map", ".min.css", ".min.js", ".pyc", ".pyo"]
# What str.strip() takes off, as one set of characters.
_BLANKS = "\t\n\u000b\u000c\r\u001c\u001d\u001e\u001f \u0085\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def _table(values: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])


def language(path: Column) -> Column:
    """by file name, else by extension; null for others."""
    name = F.element_at(F.split(path, "/"), -1)
    return F.coalesce(F.try_element_at(_table(FILE_NAMES), name), F.try_element_at(_table(LANGUAGES), F.lower(F.regexp_extract(name, r"(\.[^.]+)$", 1))))


def line_counts(text: Column, lang: Column) -> Column:
    """struct<total,blank,comment,code>."""
    own = F.transform(lines(text), lambda x: F.btrim(x, F.lit(_BLANKS)))
    filled = F.filter(own, lambda x: x != "")
    starts = F.coalesce(F.try_element_at(F.create_map(*[x for k, v in COMMENTS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))]), lang), F.array().cast("array<string>"))
    comments = F.size(F.filter(filled, lambda x: F.exists(starts, lambda p: F.startswith(x, p))))
    total = F.size(own)
    return F.struct(total.alias("total"), (total - F.size(filled)).alias("blank"), comments.alias("comment"), (F.size(filled) - comments).alias("code"))


def loc_summary(files: DataFrame) -> DataFrame:
    """Files and lines by language, with a row TOTAL; files (path, text) of unknown languages are left out."""
    own = files.withColumn("language", language(F.col("path"))).where("language is not null").withColumn("c", line_counts(F.col("text"), F.col("language")))
    out = own.rollup("language").agg(F.count("*").alias("files"), *[F.sum(f"c.{k}").alias(k) for k in ("total", "blank", "comment", "code")])
    return out.withColumn("language", F.coalesce("language", F.lit("TOTAL")))


def line_delta(old: Column, new: Column, lang: Column) -> Column:
    """struct<added,removed,net> of total lines from old to new text."""
    d = line_counts(new, lang)["total"] - line_counts(old, lang)["total"]
    return F.struct(F.greatest(d, F.lit(0)).alias("added"), F.greatest(-d, F.lit(0)).alias("removed"), d.alias("net"))


def patch_lines(patches: DataFrame, id_col: str = "id") -> DataFrame:
    """(id, file, added, removed) of patch texts (id, patch); lines before a file's header belong to no file."""
    header = r"^(?:\*\*\* (?:Add|Update|Delete) File: |\+\+\+ (?:b/)?)(.+)$"
    start = F.struct(F.lit(None).cast("string").alias("file"), F.array().cast("array<struct<file:string,sign:string>>").alias("out"))

    def step(acc: Column, line: Column) -> Column:
        head = F.when(line.rlike(header), F.trim(F.regexp_extract(line, header, 1)))
        sign = F.when(head.isNull() & ~F.startswith(line, F.lit("---")) & ~F.startswith(line, F.lit("***")) & F.substring(line, 1, 1).isin("+", "-"), F.substring(line, 1, 1))
        return F.struct(F.coalesce(head, acc["file"]).alias("file"), F.when(sign.isNotNull() & acc["file"].isNotNull(), F.concat(acc["out"], F.array(F.struct(acc["file"].alias("file"), sign.alias("sign"))))).otherwise(acc["out"]).alias("out"))

    rows = patches.select(id_col, F.explode(F.aggregate(lines(F.col("patch")), start, step, lambda a: a["out"])).alias("l"))
    return rows.groupBy(id_col, F.col("l.file").alias("file")).agg(F.count_if(F.col("l.sign") == "+").alias("added"), F.count_if(F.col("l.sign") == "-").alias("removed"))


_CALL = "struct<id:string,name:string,input:string>"


def tool_calls(payload: Column) -> Column:
    """array of (id, name, arguments as JSON) from a message: content blocks, output items or tool_calls."""
    blocks = F.from_json(F.get_json_object(payload, "$.content"), "array<struct<type:string,id:string,name:string,input:string>>")
    a = F.transform(F.filter(blocks, lambda b: b["type"] == "tool_use"), lambda b: F.struct(b["id"], b["name"], b["input"]).cast(_CALL))
    items = F.from_json(F.get_json_object(payload, "$.output"), "array<struct<type:string,call_id:string,name:string,arguments:string>>")
    b = F.transform(F.filter(items, lambda x: x["type"] == "function_call"), lambda x: F.struct(x["call_id"], x["name"], x["arguments"]).cast(_CALL))
    calls = F.from_json(F.get_json_object(payload, "$.tool_calls"), "array<struct<id:string,function:struct<name:string,arguments:string>>>")
    c = F.transform(calls, lambda x: F.struct(x["id"], x["function"]["name"], x["function"]["arguments"]).cast(_CALL))
    empty = F.array().cast(f"array<{_CALL}>")
    return reduce(F.concat, [F.coalesce(x, empty) for x in (a, b, c)])


def write_events(messages: DataFrame, id_col: str = "id") -> DataFrame:
    """(id, call_id, file_path, added, removed, net) of Write, Edit and MultiEdit calls; edits of a call are summed."""
    calls = messages.select(id_col, F.explode(tool_calls(F.col("payload"))).alias("c")).where(F.lower("c.name").isin("write", "edit", "multiedit", "create_file", "str_replace"))
    get = lambda p: F.get_json_object("c.input", p)
    edits = F.from_json(get("$.edits"), "array<struct<old_string:string,new_string:string>>")
    single = F.array(F.struct(F.coalesce(get("$.old_string"), F.lit("")).alias("old_string"), F.coalesce(get("$.new_string"), get("$.content"), F.lit("")).alias("new_string")))
    path = F.coalesce(get("$.file_path"), get("$.path"), F.lit("(unknown)"))
    rows = calls.select(id_col, F.col("c.id").alias("call_id"), path.alias("file_path"), F.explode(F.coalesce(edits, single)).alias("e"))
    d = line_delta(F.coalesce("e.old_string", F.lit("")), F.coalesce("e.new_string", F.lit("")), language(F.col("file_path")))
    return rows.withColumn("d", d).groupBy(id_col, "call_id", "file_path").agg(*[F.sum(f"d.{k}").alias(k) for k in ("added", "removed", "net")], F.count("*").alias("operation_count"))


def written_summary(events: DataFrame) -> DataFrame:
    """Lines written by file, with a row of null path for all."""
    return events.withColumn("file_path", F.coalesce("file_path", F.lit("(unknown)"))).rollup("file_path").agg(*[F.sum(k).alias(k) for k in ("added", "removed", "net", "operation_count")], F.count_distinct("file_path").alias("files"))


def correlate_writes(uses: DataFrame, results: DataFrame) -> DataFrame:
    """Write calls (session_id, id, path) with their results (session_id, tool_use_id, path): by id, else by path or file name."""
    name = lambda c: F.element_at(F.split(c, "/"), -1)
    by_id = uses.join(results.select("session_id", F.col("tool_use_id").alias("id")), ["session_id", "id"], "left_semi").select("session_id", "id", "path", F.lit("id").alias("found_by"))
    rest = uses.join(by_id.select("session_id", "id"), ["session_id", "id"], "left_anti")
    loose = results.join(uses.select("session_id", F.col("id").alias("tool_use_id")), ["session_id", "tool_use_id"], "left_anti").where("path is not null").select("session_id", name(F.col("path")).alias("_n"), F.col("path").alias("_p"))
    by_path = rest.withColumn("_n", name(F.col("path"))).join(loose, ["session_id", "_n"]).where((F.col("_p") == F.col("path")) | ~F.contains(F.col("_p"), F.lit("/")))
    return by_id.unionByName(by_path.select("session_id", "id", "path", F.lit("path").alias("found_by")).distinct())
