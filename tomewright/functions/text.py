"""Text functions as Column expressions: numbers, paths, natural sort keys, rules' scalar parts (F-1..F-9, F-12, S-2..S-4)."""

from __future__ import annotations

import re
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark import SparkContext
from pyspark.errors import IllegalArgumentException
from pyspark.sql import Column
from pyspark.sql import functions as F

# Keywords that stand before a chapter number, in many languages, and the number's shape.
KEYWORDS = (
    r"ch(?:apter)?\.?|kapitel|glava|file|ep(?:isode|\.)?"
    r"|cap(?:[íi]tulo|itol|\.)?|chap(?:itre|\.)?"
    r"|rozdział|kapitola|fejezet|poglavlje|розділ"
    r"|chương|bab|kabanata"
)
NUMBER = r"\s*(\d+)(?:[.-](\d+))?"
CHAPTER_NUMBER = rf"(?iu)(?:{KEYWORDS}){NUMBER}|(?:第|제){NUMBER}\s*(?:話|章|话|화|장)?|(?:บทที่|အခန်း){NUMBER}"
# A plain number, the number in a title, and the folder of upscaled files.
SIMPLE_NUMBER = r"(\d+(?:\.\d+)?)"
TITLE_NUMBER = r"(?:Chapter\s*(\d+\.?\d*)|第(\d+\.?\d*)(?:話|章)(?:(?:-|ー|－)(\d*))?|Kapitel\s*(\d+\.?\d*))"
UPSCALED_SEGMENT = r"(?:^|[\\/])_upscaled(?=[\\/])"
# MIME types by extension.
IMAGE_MIME = {
    ".jpg": "image/jpeg", ".jpeg": "image/jpeg", ".png": "image/png", ".webp": "image/webp",
    ".bmp": "image/bmp", ".tiff": "image/tiff", ".tif": "image/tiff", ".avif": "image/avif",
}
INVALID_FILE_CHARS = ["\0", "/"]
# The tokens of both natural orders.
NATURAL_MIXED = r"(\d+?\.?\d*)|(\D+?\.?\D*)"
NATURAL_RUNS = r"\d+|\D+"
DECIMAL = "decimal(28,10)"


def _group(text: Column, pattern: str, *groups: int) -> Column:
    """The first of some groups that is not empty; null if none is."""
    return F.coalesce(*(F.nullif(F.regexp_extract(text, pattern, g), F.lit("")) for g in groups))


def keyword_number(text: Column) -> Column:
    """F-2's part of F-1: the number after a chapter keyword, ``main.sub`` if it has a part; else null."""
    main, sub = _group(text, CHAPTER_NUMBER, 1, 3, 5), _group(text, CHAPTER_NUMBER, 2, 4, 6)
    return F.when(sub.isNotNull(), F.concat_ws(".", main, sub)).otherwise(main)


def extract_number(text: Column) -> Column:
    """F-1: the number after a keyword, else the first plain number, else null."""
    return F.coalesce(keyword_number(text), _group(text, SIMPLE_NUMBER, 1))


def resolve_number(number: Column, title: Column, file_name: Column) -> Column:
    """F-2: a metadata number that is not empty, else the title's keyword number, else the file name's."""
    return F.coalesce(F.nullif(number, F.lit("")), keyword_number(title), keyword_number(file_name))


def base_number(number: Column) -> Column:
    """F-3: the whole part of a decimal number; of other text, what stands before the first dot."""
    return F.coalesce(F.floor(number.try_cast(DECIMAL)).cast("string"), F.substring_index(number, ".", 1))


def corrected_number(number: Column, title: Column) -> Column:
    """F-4: the title's number where it differs from the metadata's or the metadata has none that parses."""
    main, sub = _group(title, TITLE_NUMBER, 1, 2, 4), _group(title, TITLE_NUMBER, 3)
    found = F.when(sub.isNotNull(), F.concat_ws(".", main, sub)).otherwise(main).try_cast(DECIMAL)
    told = number.try_cast(DECIMAL)
    shown = F.regexp_replace(F.regexp_replace(found.cast("string"), r"(\.\d*?)0+$", "$1"), r"\.$", "")
    return F.when(found.isNotNull() & (told.isNull() | (found != told)), shown).otherwise(number)


def merged_name(name: Column, base: Column) -> Column:
    """F-5: every keyword number of a name replaced by the base number; a part after a dot goes with it.

    A number whose part stands after a hyphen stays: the joined form ``5.2`` does not occur in ``5-2``.
    """
    pattern = rf"(?iu)(?<kw>(?:{KEYWORDS}|第|제|บทที่|အခန်း)\s*)\d++(?:\.\d++|(?!-\d))"
    literal = F.replace(F.replace(base, F.lit("\\"), F.lit("\\\\")), F.lit("$"), F.lit("\\$"))
    return F.regexp_replace(name, F.lit(pattern), F.concat(F.lit("${kw}"), literal))


def merged_file_name(name: Column, base: Column) -> Column:
    """F-5 for a file: the stem's numbers change, the extension stays."""
    extension = F.regexp_extract(name, r"(\.[^./\\]*)$", 1)
    return F.concat(merged_name(F.regexp_replace(name, r"\.[^./\\]*$", ""), base), extension)


def merged_title(title: Column, base: Column) -> Column:
    """F-5 for a title: none stays none."""
    return F.when(title != "", merged_name(title, base))


def escape_file_name(name: Column, invalid: list[str] | None = None) -> Column:
    """F-6: characters a file name must not hold, percent-encoded in upper hex."""
    return reduce(lambda c, x: F.replace(c, F.lit(x), F.lit(f"%{ord(x):02X}")), invalid or INVALID_FILE_CHARS, name)


def escape_directory_name(name: Column, invalid: list[str] | None = None) -> Column:
    """F-6: as a file name; names of dots and blanks only are neutralised and never empty."""
    escaped = escape_file_name(name, invalid)
    encoded = F.rtrim(F.replace(escaped, F.lit("."), F.lit("%2E")))
    return F.when(escaped.rlike(r"^\.*[ .]*$"), F.when(encoded == "", F.lit("%20")).otherwise(encoded)).otherwise(escaped)


def is_upscaled_path(path: Column) -> Column:
    """FLT-13: whether a path has a segment ``_upscaled``."""
    return path.rlike(UPSCALED_SEGMENT)


def canonical_path(path: Column) -> Column:
    """F-7: a path without its ``_upscaled`` segment."""
    return F.regexp_replace(path, UPSCALED_SEGMENT, "")


def string_diff(old: Column, new: Column) -> Column:
    """F-8: struct (prefix, changed, suffix) of ``new``: the longest common prefix, then suffix, with ``old``."""
    old, new = F.coalesce(old, F.lit("")), F.coalesce(new, F.lit(""))
    short = F.least(F.length(old), F.length(new))

    def common(a: Column, b: Column, most: Column) -> Column:
        """Length of the common prefix within ``most`` characters: where the first unequal pair of characters stands."""
        pairs = F.zip_with(F.split(F.left(a, most), ""), F.split(F.left(b, most), ""), lambda x, y: x == y)
        first = F.array_position(pairs, False)
        return F.when(first == 0, most).otherwise(F.least(first - 1, most)).cast("int")

    start = common(old, new, short)
    end = common(F.reverse(old), F.reverse(new), short - start)
    return F.struct(
        F.left(new, start).alias("prefix"), F.substring(new, start + 1, F.length(new) - start - end).alias("changed"), F.right(new, end).alias("suffix")
    )


def html_encode(text: Column) -> Column:
    """F-8: the five characters that HTML text must not hold."""
    pairs = [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")]
    return reduce(lambda c, p: F.replace(c, F.lit(p[0]), F.lit(p[1])), pairs, text)


def content_hash(content: Column) -> Column:
    """F-9: MD5 in lower hex."""
    return F.md5(content)


def mime_type(extension: Column) -> Column:
    """F-12: MIME type of an image extension, with or without its dot, any case; else null."""
    dotted = F.lower(F.when(F.startswith(extension, F.lit(".")), extension).otherwise(F.concat(F.lit("."), extension)))
    return F.element_at(F.create_map(*(F.lit(x) for pair in IMAGE_MIME.items() for x in pair)), dotted)


def is_image_extension(extension: Column) -> Column:
    """FLT-14."""
    return F.coalesce(mime_type(extension).isNotNull(), F.lit(False))


def ends_with_any(text: Column, suffixes: list[str]) -> Column:
    """FLT-15."""
    return reduce(lambda a, b: a | b, (F.endswith(text, F.lit(s)) for s in suffixes), F.lit(False))


def contains_ignore_case(text: Column, needle: str) -> Column:
    """FLT-3: substring test in lower case; blanks around the needle do not count. Case follows Unicode on both sides."""
    return F.contains(F.lower(text), F.lit(needle.strip().lower()))


def natural_tokens(text: Column) -> Column:
    """S-2: a name's tokens; a decimal is taken only after a one-digit integer, which is part of the order and kept."""
    return F.regexp_extract_all(text, F.lit(NATURAL_MIXED), F.lit(0))


def natural_key(text: Column) -> Column:
    """S-2: sort key of natural order for names whose tokens stand in step: (kind, number, text); text ignores case.

    A number and a text in one place compare by kind here, numbers first; :func:`natural_compare` has the whole rule.
    Null sorts first.
    """
    return F.transform(natural_tokens(text), lambda t: F.struct(t.try_cast("double").isNull().alias("is_text"), F.coalesce(t.try_cast("double"), F.lit(0.0)).alias("num"), F.when(t.try_cast("double").isNull(), F.upper(t)).otherwise(F.lit("")).alias("txt")))


def natural_compare(a: Column, b: Column) -> Column:
    """S-2: -1, 0 or 1: the first pair of tokens that differs decides, two numbers as doubles, others as text that ignores
    case; then fewer tokens come first, and null before all."""

    def of(x: Column, y: Column) -> Column:
        m, n = x.try_cast("double"), y.try_cast("double")
        number = F.when(m < n, -1).when(m > n, 1).otherwise(0)
        p, q = F.upper(x), F.upper(y)
        return F.when(m.isNotNull() & n.isNotNull(), number).otherwise(F.when(p < q, -1).when(p > q, 1).otherwise(0))

    left, right = natural_tokens(a), natural_tokens(b)
    both = F.least(F.size(left), F.size(right))
    pairs = F.zip_with(F.slice(left, 1, both), F.slice(right, 1, both), of)
    first = F.element_at(F.concat(F.filter(pairs, lambda c: c != 0), F.array(F.signum(F.size(left) - F.size(right)).cast("int"))), 1)
    return F.when(a.isNull() & b.isNull(), 0).when(a.isNull(), -1).when(b.isNull(), 1).otherwise(first)


def natural_sorted(items: Column, name: str) -> Column:
    """S-2: an array of structs in natural order of one field, by comparing pairs."""
    return F.array_sort(items, lambda x, y: natural_compare(x[name], y[name]))


def natural_key_strict(text: Column) -> Column:
    """S-3: runs of digits and of others; digits compare as whole numbers of any size, others case-sensitively."""
    runs = F.regexp_extract_all(text, F.lit(NATURAL_RUNS), F.lit(0))
    return F.transform(runs, lambda t: F.struct((~t.rlike(r"^\d")).alias("is_text"), F.when(t.rlike(r"^\d"), F.coalesce(t.try_cast("decimal(38,0)"), F.lit("9" * 38).cast("decimal(38,0)"))).otherwise(F.lit(0).cast("decimal(38,0)")).alias("num"), F.when(t.rlike(r"^\d"), F.lit("")).otherwise(t).alias("txt")))


def chapter_key(title: Column) -> Column:
    """S-4: a chapter's sort key inside its series: decimal number, then natural order."""
    return F.struct(extract_number(title).try_cast(DECIMAL).alias("number"), natural_key(title).alias("key"))


def valid_regex(pattern: str | None) -> bool:
    """F-21: blank patterns are valid; tested on the driver, once per rule, by the engine that runs them."""
    if not pattern or not pattern.strip():
        return True
    context = SparkContext._active_spark_context
    if context is None:
        raise RuntimeError("patterns are tested by a session's JVM: start one first")
    try:
        context._jvm.java.util.regex.Pattern.compile(pattern)
    except (Py4JJavaError, IllegalArgumentException):
        return False
    return True


def pattern_groups(pattern: str) -> tuple[int, set[str]]:
    """How many groups a valid pattern has, and the names of those that have one."""
    compiled = SparkContext._active_spark_context._jvm.java.util.regex.Pattern.compile(pattern)
    named = set(re.findall(r"\(\?<([A-Za-z][A-Za-z0-9]*)>", pattern))
    return compiled.matcher("").groupCount(), named


def trimmed(text: Column) -> Column:
    """White space of any kind off both ends, as Unicode counts it."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def encode_base64(content: Column) -> Column:
    """F-17: one line of base64."""
    return F.replace(F.base64(content), F.lit("\r\n"), F.lit(""))


def decode_base64(text: Column) -> Column:
    """F-17: the bytes of base64, null where it is none."""
    return F.try_to_binary(text, F.lit("base64"))


def sniff_format(content: Column) -> Column:
    """SRC-12: image extension by the first bytes; null if none is known."""
    head = F.hex(F.substring(content, 1, 16))
    return (
        F.when(head.startswith("FFD8FF"), ".jpg")
        .when(head.startswith("89504E470D0A1A0A"), ".png")
        .when(head.startswith("52494646") & (F.substring(head, 17, 8) == "57454250"), ".webp")
        .when(head.startswith("424D"), ".bmp")
        .when(head.startswith("49492A00") | head.startswith("4D4D002A"), ".tiff")
        .when((F.substring(head, 9, 8) == "66747970") & ((F.substring(head, 17, 8) == "61766966") | (F.substring(head, 25, 8) == "61766966")), ".avif")
    )
