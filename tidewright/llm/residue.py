"""Records that hold template residue, filler, an error page or a script notice instead of content.

A placeholder detector finds unfilled fields that stand in running text; code blocks and quoted code are taken out first, so texts
that show or discuss placeholders are left alone.

For whole responses, the text is cut into segments, and what is left without title, page frame and stray characters is the
response's body. Segments are compared over the corpus without their numbers and names. A segment is learned as a message if

* it is duplicated: several responses of several hosts at several places have it ("host" is the tenant that a record was collected
  from, "place" its title with the address slug),
* it is mismatched: in most of them it shares no term with the title or the slug,
* it carries little information: it makes up a large part of the bodies that it stands in, and hardly ever stands in long ones.

Then, in a second and third look, a duplicated and mismatched segment that mostly stands beside learned ones is a message
too. Word lists (lexicon.py) are the last evidence, for messages that are too rare in the corpus to be learned. A record is residue if its
body holds a message and nothing else. Records of any length count in all of this and are judged alike.

Everything is expressions on the JVM; texts are cut once, and the shuffles are of distinct segments and of records that hold a message.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewright.llm import lexicon
from tidewright.operators.skew import lookup_join
from tidewright.session import materialise

#: A learned message: least responses; least part of a body that it makes up on average, over ``PRIOR`` more responses in which it makes up nothing.
LEAST, PART, PRIOR = 3, 0.22, 4
#: A body of more segments than LONG is long; most of a message's responses that may be long, least that must be mismatched, and least beside other messages.
LONG, LONG_SHARE, MISMATCH_SHARE, BESIDE_SHARE = 10, 0.1, 0.6, 0.5
#: Stray characters at the end: least share of a segment's responses that it ends. One of so few characters needs no evidence.
LAST_SHARE, STRAY_CHARS = 0.9, 12
#: A first line of more characters is no title but content.
TITLE_CHARS = 160
#: No listed page frame is longer, in characters, so longer segments needn't be tried.
FRAME_CHARS = 64
#: Looks at segments beside messages.
LOOKS = 2

_NAME = r"[\p{L}_.][\p{L}\p{N}_.  　-]{0,40}"
_FILL = r"insert|enter|fill|add|your|replace|todo|choose|select|ins[eé]r|inser|inclu|rellen|complet|compl[eé]t|à compl|preench|remplir|rempl|einfüg|eintrag|hier|указ|встав|введ|запол|填|输入|入力|記入|插入|here|aqu[ií]|ici"
_TAG = r"/?(?:html|head|title|body|h[1-6]|p|noscript|script|div|span|a|br|hr|ul|ol|li|table|tr|td|th|strong|em|b|i|u|center|meta|link|style|img|form|input|button|pre|code|main|nav|header|footer|section|article|label|small)"

#: Unfilled fields, by syntax.
PLACEHOLDERS = [
    r"\{\{[^{}\n]{1,60}\}\}",
    r"[$#]\{[^{}\n]{1,60}\}",
    r"\{%[^%\n]{1,60}%\}",
    r"<%[=-]?[^%\n]{1,60}%>",
    r"%\([\p{L}_][\p{L}\p{N}_ ]*\)[sdifr]",
    r"(?<![\p{L}\p{N}%])%[\p{L}_][\p{L}_]{0,40}%(?![\p{L}\p{N}])",
    r"@@[^@\s][^@\n]{0,40}@@",
    r"<<[^<>\n]{1,60}>>",
    r"(?<![\p{L}\p{N}_])__[\p{L}][\p{L}\p{N}_]*?__(?![\p{L}\p{N}_])",
    r"(?<=[\p{L}\p{N},;:(][  ]{1,3})_{4,}|_{4,}(?=[  ]{1,3}[\p{L}\p{N}(])",
    r"(?<![\p{L}\p{N}$])\$[\p{L}_][\p{L}\p{N}_]*\$",
    r"\[\[" + _NAME + r"\]\]",
    r"【[^【】\n]{1,60}】",
    r"\[[^\[\]\n]{0,60}(?i:" + _FILL + r")[^\[\]\n]{0,60}\](?!\()",
    r"(?m)(?<!^)\[(?!(?:ERROR|WARN|WARNING|INFO|DEBUG|TRACE|FATAL|NOTICE|HOT|COLD)\])[A-Z][A-Z]+(?:[ _-][A-Z]+)*\](?!\()|^\[(?!(?:ERROR|WARN|WARNING|INFO|DEBUG|TRACE|FATAL|NOTICE|HOT|COLD|BODY TEXT)\])[A-Z][A-Z]+(?:[ _-][A-Z]+)*\](?!\()(?=.)",
    r"\((?i:enter|insert|fill in|your|add)[  ]+[\p{L}_  ]{1,30}\)",
    r"(?<![\p{L}\p{N}])<[^<>\n]{0,40}(?i:" + _FILL + r")[^<>\n]{0,40}>",
    r"(?<![\p{L}\p{N}<])<(?!(?i:" + _TAG + r")>)[\p{L}][\p{L}]+(?:[_ -][\p{L}]+){0,4}>(?!>)",
    r"(?<![{$#%\"'])\{(?:[\p{L}_][\p{L}\p{N}_]{0,40}|\d)\}(?!\})",
    r"(?<![\p{L}\p{N}])X{4,}(?![\p{L}\p{N}])",
]
_CODE = r"(?s)```.*?(?:```|\z)|``[^`]*``|`[^`\n]*`"
#: Fenced code without its language.
_FENCE = r"(?s)```[\w+-]*(.*?)(?:```|\z)"
#: Accents are taken off before the lists are tried, so that composed and decomposed letters are alike; the same is done to the lists.
_ACCENTED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿёй"
_BASE = "aaaaaaceeeeiiiinooooouuuuyyеи"
#: Characters without a width: soft hyphen, zero-width ones, byte order mark, combining accents.
_NO_WIDTH = r"[­﻿​-‍⁠̀-ͯ]+"
#: Line ends, and ends of sentences and fields within a line; the latter leave a mark, as only a whole line can be a title.
_LINES, _MARK = r"\n\r\x0b\x0c\u0085  ", "\x01"
_BREAKS = r"(?=[.!?…。！？\",|·•»›])(?:[.!?…]\h+(?=[^\h" + _LINES + r"])|[。！？](?=[^" + _LINES + r"])|\"\h?:\h?|,\h?\"|[|·•»›]\h)"
#: Numbers with their units, and identifiers.
_NUMBERS = r"(?<![a-z\d])[a-z]*+(?:\d|[-_][a-z\d])(?:[a-z\d.,:%/+_-]*[a-z\d%])?(?:\h+(?:ms|s|min|h)(?![a-z]))?"


def _whole(patterns: list[str]) -> str:
    return "^(?:" + "|".join(f"(?:{p})" for p in patterns).translate(str.maketrans(_ACCENTED, _BASE)) + ")$"


_MESSAGE = _whole([*lexicon.SCRIPT, *lexicon.ERROR, *lexicon.FILLER])
_FRAME = _whole(lexicon.FRAME)


def _is_ascii(text: Column) -> Column:
    return F.octet_length(text) == F.length(text)


def _plain(text: Column) -> Column:
    """The text without characters that have no width, every blank a plain one."""
    wide = F.regexp_replace(F.regexp_replace(text, _NO_WIDTH, ""), r"[\h&&[^ ]]", " ")
    return F.when(_is_ascii(text), F.replace(text, F.lit("\t"), F.lit(" "))).otherwise(wide)


def has_placeholder(plain: Column) -> Column:
    """Whether an unfilled field stands in a plain text outside of code. Null gives false."""
    outside = F.when(plain.contains("`"), F.regexp_replace(plain, _CODE, " ")).otherwise(plain)
    # every syntax begins with one of these characters, so the alternatives are tried at few places
    return F.coalesce(outside.rlike(r"(?=[{$#<%@_\[【(X])(?:" + "|".join(f"(?:{p})" for p in PLACEHOLDERS) + ")"), F.lit(False))


def _flat(text: Column) -> Column:
    """Lower case without characters that have no width."""
    return F.when(_is_ascii(text), F.lower(text)).otherwise(F.regexp_replace(F.lower(text), _NO_WIDTH, ""))


def _normal(flat: Column) -> Column:
    """A flat text without tags and punctuation, numbers and names as ``0``, one blank between words; ends of segments within a line are marks."""
    plain = F.when(flat.contains("<"), F.regexp_replace(flat, r"</?[a-z!][^<>" + _LINES + r"]{0,60}>", "\n")).otherwise(flat)
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(plain, _NUMBERS, "0"), _BREAKS, _MARK), rf"[^\p{{L}}\p{{N}}{_LINES}{_MARK}]+", " ")


def segments(normal: Column) -> Column:
    """Sentences and lines of a normalised text in order, without those that have no two letters in a row."""
    return F.filter(F.transform(F.split(normal, f"[{_LINES}{_MARK}]"), lambda s: F.trim(s)), lambda s: s.rlike(r"\p{L}{2}"))


def _is_frame(s: Column) -> Column:
    return (F.length(s) <= FRAME_CHARS) & s.rlike(_FRAME)


def is_message(s: Column) -> Column:
    """Whether a normalised segment is, from end to end, a listed error message, script notice or filler."""
    s = F.translate(s, _ACCENTED, _BASE)
    words = F.split(s, " ")
    known = F.array(*[F.lit(w) for w in dict.fromkeys(lexicon.LATIN)])
    own = F.array_distinct(words)
    latin = (F.size(own) >= 3) & (F.size(F.array_intersect(own, known)) >= F.size(own) * 0.6)
    return s.rlike(_MESSAGE) | latin


def _identity(s: Column) -> Column:
    """The hash of a segment's distinct words, so that one phrase said over and over is that phrase."""
    return F.xxhash64(F.array_distinct(F.split(s, " ")))


def _terms(c: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), r"[^\p{L}]+"), lambda w: F.length(w) > 3)


def _once(df: DataFrame) -> DataFrame:
    """``df`` behind a generator of one row: the optimizer then can't copy its expressions into lambdas that use them per element."""
    return df.select(F.explode(F.array(F.struct(*df.columns))).alias("__row")).select("__row.*")


def _records(docs: DataFrame) -> DataFrame:
    """One row per record with a body: row, doc_id, tenant, place, c (segments of the body), body.

    ``body``: each distinct segment once, with its text ``s``, identity ``m``, whether it stands in fenced code (``code``), shares a term with title
    or slug (``own``), ends the record (``last``), or is its title and not counted (``title``). Segments in code are part of what is left of a record, but no evidence.
    """
    fenced = F.col("text").contains("```")
    outside = F.when(fenced, F.regexp_replace("text", _FENCE, "\n")).otherwise(F.col("text"))
    inside = F.when(fenced, F.array_join(F.regexp_extract_all("text", F.lit(_FENCE), F.lit(1)), "\n"))
    rows = _once(docs.select("doc_id", "tenant", F.lower("path").alias("path"), _flat(outside).alias("out"), _flat(inside).alias("in")).withColumn("row", F.monotonically_increasing_id()))
    none = F.array().cast("array<string>")
    rows = _once(rows.select("doc_id", "tenant", "path", "row", _normal(F.col("out")).alias("normal"), F.when(F.col("in").isNull(), none).otherwise(segments(_normal(F.col("in")))).alias("inside")))
    rows = _once(rows.withColumn("segs", F.filter(segments(F.col("normal")), lambda s: ~_is_frame(s))))
    rows = rows.withColumns({"end": F.element_at(F.concat(F.array(F.lit("")), "segs"), -1), "first": F.coalesce(F.get("segs", F.lit(0)), F.lit(""))})
    # a title is a whole line: its segment doesn't end within one
    after = F.substring(F.col("normal"), F.instr(F.col("normal"), F.col("first")) + F.length("first"), F.lit(2))
    titled = (F.size(F.array_distinct("segs")) > 1) & ~after.contains(_MARK) & (F.length("first") <= TITLE_CHARS)
    rows = _once(rows.withColumn("title", F.when(titled, F.col("first"))).drop("normal", "first"))
    rest = F.array_distinct(F.filter("segs", lambda s: ~s.eqNullSafe(F.col("title"))))
    code = F.array_except(F.array_distinct("inside"), "rest")
    terms = F.array_distinct(_terms(F.concat_ws(" ", "title", "path")))
    rows = _once(_once(rows.withColumn("rest", rest)).withColumn("code", code).withColumn("terms", terms)).withColumn("c", F.size("rest") + F.size("code")).where("c > 0")
    split = F.transform("rest", lambda s: F.struct(s.alias("s"), F.array_distinct(F.split(s, " ")).alias("w")))
    outer = F.transform(split, lambda x: F.struct(x["s"].alias("s"), F.xxhash64(x["w"]).alias("m"), F.lit(False).alias("code"), F.arrays_overlap(x["w"], "terms").alias("own"), (x["s"] == F.col("end")).alias("last"), F.lit(False).alias("title")))
    inner = F.transform("code", lambda s: F.struct(s.alias("s"), _identity(s).alias("m"), F.lit(True).alias("code"), F.lit(False).alias("own"), F.lit(False).alias("last"), F.lit(False).alias("title")))
    place = F.xxhash64("title", F.regexp_replace("path", _NUMBERS, "0"))
    title = F.struct(F.col("title").alias("s"), _identity(F.col("title")).alias("m"), F.lit(False).alias("code"), F.lit(False).alias("own"), F.lit(False).alias("last"), F.lit(True).alias("title"))
    head = F.when(F.col("title").isNotNull(), F.array(title))
    return rows.select("row", "doc_id", "tenant", place.alias("place"), "c", F.coalesce(F.concat(outer, inner, head), F.concat(outer, inner)).alias("body"))


def _groups(records: DataFrame) -> DataFrame:
    """One row per distinct segment of the corpus outside of code: its statistics over all records, the list's verdict, whether it may be stray."""
    each = records.select("tenant", "place", "c", F.explode("body").alias("p")).where("not p.code").select("tenant", "place", "c", "p.m", "p.s", "p.own", "p.last", "p.title")
    below = ~F.col("title")
    several = lambda c: F.coalesce(F.min(c) != F.max(c), F.lit(False))
    g = each.groupBy("m").agg(
        F.min("s").alias("s"), F.count_if(below).alias("n"), F.sum(F.when(below, 1 / F.col("c"))).alias("part"), F.count_if(below & (F.col("c") > LONG)).alias("long"), F.count_if(below & ~F.col("own")).alias("mismatched"),
        F.count_if("last").alias("ends"), several(F.when(below, F.col("tenant"))).alias("hosts"), several(F.when(below, F.col("place"))).alias("places"),
    )
    repeated = (F.col("n") >= LEAST) & F.col("hosts") & F.col("places")
    mismatched = F.col("mismatched") >= F.col("n") * MISMATCH_SHARE
    learned = repeated & mismatched & (F.col("part") >= (F.col("n") + PRIOR) * PART) & (F.col("long") <= F.col("n") * LONG_SHARE)
    stray = (F.length("s") <= STRAY_CHARS) | (repeated & (F.col("ends") >= F.col("n") * LAST_SHARE))
    return g.select("m", "n", mismatched.alias("mismatched"), learned.alias("learned"), stray.alias("stray"), is_message(F.col("s")).alias("listed"))


def _hits(records: DataFrame, marks: DataFrame) -> DataFrame:
    """Records that hold a message outside of code, as title too: row, doc_id, tenant, c, ms (their messages), known and code (messages outside and in code), learned (of the former), loose (a last segment that may be stray), headed (the title is a message)."""
    each = records.select("row", "doc_id", "tenant", "c", F.explode("body").alias("p")).select("row", "doc_id", "tenant", "c", "p.m", "p.code", "p.last", "p.title")
    hit = lookup_join(each, marks, ["m"], ["row"], "inner")
    told, below = (F.col("kind") > 0) & ~F.col("code"), ~F.col("title")
    out = hit.groupBy("row").agg(
        F.first("doc_id").alias("doc_id"), F.first("tenant").alias("tenant"), F.first("c").alias("c"), F.collect_set(F.when((F.col("kind") > 0) & below, F.col("m"))).alias("ms"),
        F.count_if(told & below).alias("known"), F.count_if((F.col("kind") > 0) & F.col("code")).alias("code"), F.count_if(told & (F.col("kind") > 1)).alias("learned"),
        F.count_if((F.col("kind") == 0) & F.col("last") & ~F.col("code")).alias("loose"), F.count_if(told & F.col("title")).alias("headed"),
    )
    return out.where("known + headed > 0")


def _beside(records: DataFrame, hits: DataFrame, marks: DataFrame, groups: DataFrame) -> DataFrame:
    """Mismatched segments that are no message yet and mostly stand beside messages, in responses of several hosts."""
    each = hits.select("row", "ms").join(records.select("row", "tenant", "body"), "row").select("tenant", "ms", F.explode("body").alias("p")).where("not p.code and not p.title and not array_contains(ms, p.m)")
    several = F.coalesce(F.min("tenant") != F.max("tenant"), F.lit(False))
    near = each.groupBy("p.m").agg(F.count(F.lit(1)).alias("beside"), several.alias("hosts")).where(F.col("hosts") & (F.col("beside") >= LEAST))
    found = near.join(groups.select("m", "n", "mismatched"), "m").where(F.col("mismatched") & (F.col("beside") >= F.col("n") * BESIDE_SHARE))
    return found.select("m", F.lit(2).alias("kind"))


def _marks(records: DataFrame) -> DataFrame:
    """Segments that tell: m, kind (2 learned message, 1 listed message, 0 may be stray at the end)."""
    groups = materialise(_groups(records), "segments")
    kind = F.when(F.col("learned"), 2).when(F.col("listed"), 1).when(F.col("stray"), 0)
    marks = groups.where("learned or listed or stray").select("m", kind.alias("kind"))
    for _ in range(LOOKS):
        messages = materialise(marks, "messages")
        more = _beside(records, _hits(records, messages.where("kind > 0")), messages, groups)
        # a segment that was stray before is a message now
        marks = messages.unionAll(more).groupBy("m").agg(F.max("kind").alias("kind"))
    return materialise(marks, "messages")


def find_residue(docs: DataFrame) -> DataFrame:
    """doc_id and the evidence of every residue record: placeholder, learned (some message of the body was learned) or message (all are of the lists only).

    ``docs`` has doc_id, text, path, tenant; other columns are ignored. Null, empty and blank texts are not residue. Null paths and
    tenants lack their evidence. A record may have two kinds of evidence; repeated rows give repeated results.
    """
    records = materialise(_records(docs), "records")
    hits = _hits(records, _marks(records))
    whole = hits.where(F.col("known") + F.col("code") + F.col("loose") == F.col("c"))
    known = _once(docs.select("doc_id", _plain(F.col("text")).alias("plain"))).where(has_placeholder(F.col("plain"))).select("doc_id", F.lit("placeholder").alias("evidence"))
    return known.unionAll(whole.select("doc_id", F.when(F.col("learned") > 0, "learned").otherwise("message").alias("evidence")))


def without_residue(docs: DataFrame) -> DataFrame:
    """``docs`` without the residue records; all columns are kept. Null ids are kept."""
    found = find_residue(docs).select(F.col("doc_id").alias("__id")).distinct()
    return docs.join(found, docs["doc_id"] == found["__id"], "left_anti")
