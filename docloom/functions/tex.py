"""Scalar functions on LaTeX text, all built-in expressions.

Python's \\s is Unicode white space and its . stops at newlines only, hence (?U) and (?d) in the patterns.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LINE_END = "\r\n|[\n\r\x0b\x0c\x1c-\x1e\u0085\u2028\u2029]"
# Text put where an abstract is missing, and the colour of the second language.
MISSING_ABSTRACT = "\n\\begin{abstract}\nThis paper has no abstract section.\n\\end{abstract}\n"
COLOR = "bilingualzhcolor"
# Packages that need xelatex; a text that has one in its first 5000 characters needs it.
XELATEX = ("fontspec", "xeCJK", "xetex", "unicode-math", "xltxtra", "xunicode")


def lit(s: str) -> Column:
    return F.lit(s)


def occurrences(text: Column, part: str) -> Column:
    """Non-overlapping occurrences of part."""
    return ((F.length(text) - F.length(F.replace(text, lit(part), lit("")))) / len(part)).cast("long")


def lines(text: Column) -> Column:
    """The lines without their ends; a line end at the end of the text starts no line."""
    found = F.split(text, LINE_END)
    return F.when(F.element_at(found, -1) == "", F.slice(found, 1, F.size(found) - 1)).otherwise(found)


def strip_comments(text: Column) -> Column:
    """Whole-line comments go with their lines, others from the first unescaped % on. Line ends become newlines; one at the end goes."""
    even = F.regexp_replace(text, LINE_END, "\n")
    bare = F.regexp_replace(F.regexp_replace(even, r"(?dmU)^[\s&&[^\n]]*%.*\n?", ""), r"\n\z", "")
    return F.regexp_replace(bare, r"(?d)(?<!\\)%.*", "")


def first_group(text: Column, pattern: str) -> Column:
    """Group 1 of the first match, null without one."""
    return F.when(text.rlike(pattern), F.regexp_extract(text, pattern, 1))


def title(text: Column) -> Column:
    return first_group(text, r"(?s)\\title\{(.*?)\}")


def abstract(text: Column) -> Column:
    return F.coalesce(first_group(text, r"(?s)\\abstract\{(.*?)\}"), first_group(text, r"(?s)\\begin\{abstract\}(.*?)\\end\{abstract\}"))


def normalized_meta(text: Column) -> Column:
    """Line ends and double backslashes become spaces, then pairs of spaces go, twice."""
    spaced = F.replace(F.replace(text, lit("\n"), lit(" ")), lit("\\\\"), lit(" "))
    for _ in range(2):
        spaced = F.replace(spaced, lit("  "), lit(""))
    return F.coalesce(spaced, lit("unknown"))


def after_documentclass(text: Column, added: Column) -> Column:
    """Insert after the first documentclass line; texts without one stay."""
    return F.when(text.rlike(r"(?d)\\documentclass.*\n"), F.regexp_replace(text, r"(?ds)\A(.*?\\documentclass[^\n]*\n)(.*)\z", F.concat(lit("$1"), lit("\x00"), lit("$2")))).otherwise(text).transform(
        lambda c: F.replace(c, lit("\x00"), added)
    )


def cjk_preamble(text: Column) -> Column:
    added = F.concat(lit("\\usepackage{ctex}\n"), F.when(F.contains(text, lit("{url}")), "").otherwise("\\usepackage{url}\n"))
    return after_documentclass(text, added)


def documentclass_options(text: Column) -> Column:
    """Fixed option list for CJK typesetting, with and without options before it."""
    some = F.regexp_replace(text, r"(?d)\\documentclass\[(.*?)\]\{(.*?)\}", r"\\documentclass[$1,fontset=windows,UTF8]{$2}")
    return F.regexp_replace(some, r"(?d)\\documentclass\{(.*?)\}", r"\\documentclass[fontset=windows,UTF8]{$1}")


def has_abstract(text: Column) -> Column:
    return text.rlike(r"(?d)\\begin\{abstract\}.*\n") | text.rlike(r"(?s)\\abstract\{(.*?)\}")


def insert_abstract(text: Column) -> Column:
    """A placeholder on the line after \\maketitle, else after \\begin{document}, where there is no abstract."""
    out = text
    for mark in ("\\begin{document}", "\\maketitle"):
        at = F.locate(mark, text)
        end = F.call_function("locate", lit("\n"), text, at)  # 0, the start, if the line isn't ended
        out = F.when(at > 0, F.concat(F.call_function("substring", text, lit(1), end), lit("\n\n" + MISSING_ABSTRACT + "\n\n"), F.call_function("substring", text, end + 1, F.length(text)))).otherwise(out)
    return F.when(has_abstract(text), text).otherwise(out)


def escape_percent(text: Column) -> Column:
    return F.regexp_replace(text, r"(?<!\\)%", r"\\%")


def tighten_commands(text: Column) -> Column:
    """No space between a command of 2 to 10 small letters and its brace or its backslash."""
    return F.regexp_replace(F.regexp_replace(text, r"\\([a-z]{2,10})\ \{", r"\\$1{"), r"\\\ ([a-z]{2,10})\{", r"\\$1{")


def ascii_punctuation(text: Column) -> Column:
    """Full-width colons and commas inside a command's braces become ASCII."""
    pattern = r"(?s)\\[a-z]{2,10}\{[^\}]*?\}"
    between, found = F.split(text, pattern), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    fixed = F.transform(found, lambda x: F.translate(x, "：，", ":,"))
    return F.array_join(F.zip_with(between, fixed, lambda a, b: F.concat(a, F.coalesce(b, lit("")))), "")


def repaired(result: Column, original: Column) -> Column:
    """A transformed segment made safe: escapes, spacing and punctuation, then the original where structure was lost."""
    out = ascii_punctuation(tighten_commands(escape_percent(result)))
    out = F.when(F.contains(result, lit("Traceback")) & F.contains(result, lit("[Local Message]")), original).otherwise(out)
    out = F.when(occurrences(original, "\\begin") != occurrences(out, "\\begin"), original).otherwise(out)
    return F.when(F.contains(original, lit("\\_")) & (occurrences(original, "\\_") > occurrences(out, "\\_")), F.regexp_replace(out, r"(?<!\\)_", r"\\_")).otherwise(out)


def brace_level(text: Column) -> Column:
    return occurrences(text, "{") - occurrences(text, "}")


def paragraphs(text: Column) -> Column:
    """Stripped parts between blank lines: white space with two newlines in it separates."""
    return F.filter(F.split(F.regexp_replace(text, r"(?U)\A\s+|\s+\z", ""), r"(?U)\s*?\n\s*\n\s*"), lambda x: x != "")


#: Lines that keep a segment whole.
STRUCTURAL = (r"^\s*\\begin\{", r"^\s*\\end\{", r"^\s*\\item\b", r"^\s*[\{\}]\s*$", r"^\s*\$\$\s*$", r"^\s*\\\[\s*$", r"^\s*\\\]\s*$")


def can_split(text: Column) -> Column:
    plain = ~text.rlike(r"(?U)\A\s*\z")
    for pattern in STRUCTURAL:
        plain = plain & ~text.rlike("(?dmU)" + pattern)
    return plain


def is_command_only(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)\A\s+|\s+\z", "").rlike(r"\A(\\begin\{[^}]+\}(\[[^\]]*\])?|\\end\{[^}]+\})\z")


def needs_xelatex(text: Column) -> Column:
    return F.substring(text, 1, 5000).rlike("|".join(XELATEX))


def model_limit(model: Column) -> Column:
    # The first that fits.
    return F.when(F.contains(model, lit("16k")), 16384).when(F.contains(model, lit("32k")), 32768).when(F.contains(model, lit("gpt-4")), 8192).otherwise(4096)


# Prefixes of models that take concurrent requests.
CONCURRENT_PREFIXES = ("gpt-", "chatgpt-", "api2d-", "azure-", "spark", "zhipuai", "glm-", "qwen")


def is_concurrent(model: Column) -> Column:
    out = model == "gpt-3.5-turbo"
    for prefix in CONCURRENT_PREFIXES:
        out = out | F.startswith(model, lit(prefix))
    return out


def chat_url(base: Column) -> Column:
    return F.when(F.endswith(base, lit("/chat/completions")), base).otherwise(F.concat(F.rtrim(base, lit("/")), lit("/chat/completions")))


def caption(en: Column, zh: Column) -> Column:
    both = F.concat(en, lit(f" \\quad \\quad {{\\color{{{COLOR}}}[翻译] "), zh, lit("}"))
    return F.when((en != "") & (zh != ""), both).when(zh != "", F.concat(lit(f"{{\\color{{{COLOR}}}"), zh, lit("}"))).otherwise(en)


def one_space(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))
