"""Scalar functions as Catalyst expressions, and their registration for SQL."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from quillward.functions import rules

#: Characters that file names must not show, in the wide and in the narrow set, and labels of revealed characters.
NAME_WIDE = r"[\x00-\x1F\x7F-\x9F\x{AD}\x{200B}-\x{200F}\x{2028}-\x{202E}\x{2060}-\x{2069}\x{FEFF}\x{E0000}-\x{E007F}]"
NAME_NARROW = r"[\x00-\x1F\x7F\x{200B}-\x{200F}\x{202A}-\x{202E}\x{2066}-\x{2069}\x{FEFF}]"
SUSPICIOUS = {"exe": "Windows executable", "bat": "Batch script", "cmd": "Command script", "com": "DOS executable", "scr": "Screensaver executable", "msi": "Installer package", "dll": "Dynamic library", "lnk": "Shortcut", "scf": "Shell command file", "hta": "HTML application", "vbs": "VBScript", "ps1": "PowerShell script", "jar": "Java archive"}


def lookup(entries: dict, key: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in entries.items() for x in kv])[key]


def escape_html(text: Column) -> Column:
    out = text
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def unescape_xml(text: Column) -> Column:
    out = text
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def control_name(code: Column) -> Column:
    return F.coalesce(lookup(rules.CONTROL_NAMES, code), F.concat(F.lit("Control (0x"), F.lower(F.hex(code)), F.lit(")")))


def safe_location(text: Column) -> Column:
    """A place for display: escapes, controls, directions and zero widths as question marks, at most 200 characters."""
    out = F.regexp_replace(F.coalesce(text, F.lit("")), r"\x1B\[[0-?]*[ -/]*[@-~]|\x1B\][\x00-\x{10FFFF}]*?(?:\x07|\x1B\\)|\x1B[@-_]|\x1B", "?")
    return F.substring(F.regexp_replace(out, r"[\x00-\x1F\x7F\x{85}\x{2028}\x{2029}\x{202A}-\x{202E}\x{2066}-\x{2069}\x{200B}-\x{200F}\x{61C}\x{FEFF}\x{2060}\x{180E}]", "?"), 1, 200)


def within(prefix: Column, location: Column) -> Column:
    """A location below a prefix, which is not put twice."""
    some = location.isNotNull() & (location != "")
    return F.when(some & ((location == prefix) | location.startswith(F.concat(prefix, F.lit(" > ")))), location).when(some, F.concat(prefix, F.lit(" > "), location)).otherwise(prefix)


def struct_key(text: Column) -> Column:
    return F.substring(F.regexp_replace(text, r"[\s\[\]]", "_"), 1, 64)


def suspicious_ending(name: Column) -> Column:
    """What an entry with a dangerous ending is, or null; blanks and zero bytes at the end do not count."""
    return lookup(SUSPICIOUS, F.lower(F.regexp_extract(F.regexp_replace(name, r"[\s\x00]+\z", ""), r"\.([^./\\]+)\z", 1)))


def safe_name(name: Column, narrow: bool = False) -> Column:
    return F.regexp_replace(name, NAME_NARROW if narrow else NAME_WIDE, "◌")


def reveal(c: Column) -> Column:
    """A short label of one character."""
    code = F.ascii(c)
    tag = F.concat(F.lit("TAG "), F.when(code.between(0xE0020, 0xE007E), F.char(code - 0xE0000)).otherwise(F.hex(code - 0xE0000)))
    named = F.coalesce(lookup(rules.MASK_LABELS, code), lookup(rules.CONTROL_NAMES, code))
    return F.when(code.between(0xE0000, 0xE007F), tag).when(c.rlike(f"[{rules.CLASSES['variation']}]"), F.concat(F.lit("VS "), F.hex(code))).when(c.rlike(f"[{rules.CLASSES['combining']}]"), F.lit("COMB")).otherwise(F.coalesce(named, F.concat(F.lit("U+"), F.lpad(F.hex(code), 4, "0"))))


def revealed(text: Column) -> Column:
    """A text with its invisible characters as labels; a run of combining marks is one label."""
    marks = f"[{rules.CLASSES['combining']}]{{2,}}"
    parts, runs = F.split(text, marks, -1), F.regexp_extract_all(text, F.lit(marks), F.lit(0))
    joined = F.array_join(F.zip_with(parts, runs, lambda a, r: F.concat(a, F.when(r.isNull(), "").otherwise(F.concat(F.lit("⟦COMB×"), F.length(r), F.lit("⟧"))))), "")
    own = "".join(rules.CLASSES[n] for n in ("tag", "known_invisible", "bidi_embedding", "bidi_override", "bidi_isolate", "control", "variation"))
    rest, found = F.split(joined, f"[{own}]", -1), F.regexp_extract_all(joined, F.lit(f"[{own}]"), F.lit(0))
    return F.array_join(F.zip_with(rest, found, lambda a, c: F.concat(a, F.when(c.isNull(), "").otherwise(F.concat(F.lit("⟦"), reveal(c), F.lit("⟧"))))), "")


def mail_domain(header: Column) -> Column:
    """Domain of the first address of a header, lower case."""
    address = F.coalesce(F.nullif(F.regexp_extract(header, "<([^<>]+)>", 1), F.lit("")), header)
    return F.nullif(F.lower(F.regexp_extract(address, r"@\s*([^>\"';,\s]+)", 1)), F.lit(""))


def organisation(domain: Column) -> Column:
    """The last two labels of a domain, three below a two-level one."""
    from quillward.sources.mail import TWO_LEVELS

    labels = F.filter(F.split(domain, r"\."), lambda x: x != "")
    last = lambda n: F.array_join(F.slice(labels, F.greatest(F.lit(1), F.size(labels) - n + 1), F.lit(n)), ".")
    return F.when(last(2).isin(TWO_LEVELS) & (F.size(labels) >= 3), last(3)).otherwise(last(2))


def failed_checks(header: Column) -> Column:
    """Failed checks of an authentication header, as method=result."""
    return F.transform(F.regexp_extract_all(header, F.lit(r"(?i)\b((?:dmarc|spf|dkim)\s*=\s*(?:fail|softfail|temperror|permerror))\b"), F.lit(1)), lambda x: F.lower(F.regexp_replace(x, r"\s", "")))


def external_target(target: Column) -> Column:
    """unc, jsOrData, http, file or null."""
    return F.when(target.rlike(r"^\\\\[^\\]+\\|^(?i:file:///?\\\\)"), "unc").when(target.rlike("^(?i:javascript:|data:)"), "jsOrData").when(target.rlike("^(?i:https?://)"), "http").when(target.rlike("^(?i:file:)"), "file")


def hides_value(code: Column) -> Column:
    return F.trim(code).rlike("^;+$") | code.rlike(r"(?i)\[(?:White|#FFFFFF|#FFF)\]")


def column_number(letters: Column) -> Column:
    return F.aggregate(F.split(F.upper(letters), ""), F.lit(0), lambda s, c: F.when(c == "", s).otherwise(s * 26 + F.ascii(c) - 64))


def column_letters(number: Column) -> Column:
    """Letters of a column number from 1 to 18,278."""
    return F.concat(*[F.when(number > low, F.char((F.floor((number - low - 1) / size) % 26 + 65).cast("int"))).otherwise("") for low, size in ((702, 676), (26, 26), (0, 1))])


def tool_name(name: Column) -> Column:
    clean = F.substring(F.regexp_replace(name, f"[{rules.TOOL_SIGNAL}\\x00-\\x1F\\x7F]", ""), 1, 80)
    return F.when(name.isNull(), "(unnamed)").when(clean == "", "(empty)").otherwise(clean)


def mixed_script(text: Column) -> Column:
    return (F.regexp_count(text, F.lit("[A-Za-z]")) >= 8) & text.rlike(f"[{rules.TOOL_CYRILLIC}]")


def register(spark: SparkSession) -> SparkSession:
    """Makes the findings a table function and the sanitizer a function of SQL: text_findings(text, file_type), text_clean(text, file_type, mode)."""
    from pyspark.sql.functions import pandas_udf, udtf

    from quillward.operators import sanitize, spans
    from quillward.session import ready

    @udtf(returnType=spans.SCHEMA.removeprefix("doc_id long, "))
    class Findings:
        def eval(self, text: str, file_type: str):
            for row in spans.rows_of(0, text or "", file_type or "text"):
                yield row[1:]

    spark = ready(spark)
    spark.udtf.register("text_findings", Findings)

    @pandas_udf("string")
    def clean(text: pd.Series, file_type: pd.Series, mode: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else sanitize.sanitize(t, k or "text", m)[0] for t, k, m in zip(text, file_type, mode, strict=True)], dtype=object)

    spark.udf.register("text_clean", clean)
    return spark
