"""Error-text scalars (C12-C16b) as built-in Column expressions.

Regex dialect note: word boundaries are written as explicit ASCII look-arounds
so Java's regex engine behaves like an ASCII ``\\b`` next to non-ASCII letters.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values that must equal the reference's behaviour.
UNKNOWN_ERROR = "UnknownError"
TRACEBACK_MARKER = "Traceback (most recent call last):"
CHAINED_MARKERS = ("During handling of", "The above exception")
FRAME_PATTERN = r'(?m)^\s*File "([^"]+)", line (\d+), in (.+)$'
# Unicode white space as split by the reference's field splitter.
WS = r"[\t\n\x0B\f\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
_B = r"(?<![A-Za-z0-9_])"   # ASCII \b before a word char
_E = r"(?![A-Za-z0-9_])"    # ASCII \b after a word char
# C15 rewrites, in order, each to '<?>'.
MESSAGE_NORMALIZERS = (
    r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}",  # uuid
    r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}",                                 # e-mail
    r"\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}[.,]?\d*",                                # ISO time
    r"\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}",                                            # IPv4
    _B + r"[0-9a-fA-F]{8,}" + _E,                                                       # hex >= 8
    r"(?:^|[^a-zA-Z_])(\d+)(?:[^a-zA-Z_]|$)",                                           # integer
)
PLACEHOLDER = "<?>"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


# The same white-space set as characters, for the (non-regex) trim functions.
WS_CHARS = ("\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(chr(c) for c in range(0x2000, 0x200B))
            + "\u2028\u2029\u202f\u205f\u3000")


def trim_ws(s) -> Column:
    return F.trim(_c(s), F.lit(WS_CHARS))


def ltrim_ws(s) -> Column:
    return F.ltrim(_c(s), F.lit(WS_CHARS))


def rtrim_ws(s) -> Column:
    return F.rtrim(_c(s), F.lit(WS_CHARS))


def is_identifier(s) -> Column:
    return _c(s).rlike(r"^[A-Za-z0-9_.]+$")


def lines(s) -> Column:
    return F.split(_c(s), "\n")


def first_non_empty_line(s) -> Column:
    """First line that is non-blank after trimming; the whole text if none.

    Leading white space (blank lines included) is stripped once, then the
    text up to the next newline is taken: no per-line array is built."""
    c = _c(s)
    head = F.substring_index(ltrim_ws(c), "\n", 1)
    line = rtrim_ws(head)
    return F.when(line != "", line).otherwise(c)


def error_type(message) -> Column:
    """Identifier before ': ' on the last line, else that whole line;
    empty message -> UnknownError."""
    m = trim_ws(message)
    last = trim_ws(F.substring_index(m, "\n", -1))
    ident = F.regexp_extract(last, r"^([A-Za-z0-9_.]+): ", 1)
    return F.when(m == "", F.lit(UNKNOWN_ERROR)).when(ident != "", ident).otherwise(last)


def exception_line(traceback) -> Column:
    """struct(type, message) from the last non-blank line that is not a
    chained-exception marker; bare class line -> empty message."""
    t = trim_ws(traceback)
    kept = F.filter(F.transform(lines(t), lambda x: trim_ws(x)),
                    lambda x: (x != "") & ~x.startswith(CHAINED_MARKERS[0]) & ~x.startswith(CHAINED_MARKERS[1]))
    last = F.get(kept, F.size(kept) - 1)
    ident = F.regexp_extract(last, r"^([A-Za-z0-9_.]+): ", 1)
    etype = (F.when(last.isNull(), F.lit(UNKNOWN_ERROR)).when(ident != "", ident)
             .when(is_identifier(last), last).otherwise(F.lit(UNKNOWN_ERROR)))
    # message after the first ': ' (the identifier prefix is ': '-free)
    after = F.substring(last, F.length(ident) + 3, 1 << 30)
    emsg = (F.when(last.isNull(), F.lit("")).when(ident != "", after)
            .when(is_identifier(last), F.lit("")).otherwise(last))
    return F.struct(etype.alias("type"), emsg.alias("message"))


def short_type(full_type) -> Column:
    """Text after the last dot."""
    return F.substring_index(_c(full_type), ".", -1)


def extract_traceback(message) -> Column:
    """Text from the traceback marker on, else the whole message."""
    m = _c(message)
    pos = F.locate(TRACEBACK_MARKER, m)
    return F.when(pos > 0, F.substring(m, pos, 1 << 30)).otherwise(m)


def origin_frame(traceback) -> Column:
    """C14: innermost frame struct(file, line, function); NULL if no frame."""
    tb = _c(traceback)
    return F.when(F.instr(tb, 'File "') > 0, _frame(tb))


def _frame(tb: Column) -> Column:
    files = F.regexp_extract_all(tb, F.lit(FRAME_PATTERN), F.lit(1))
    nums = F.regexp_extract_all(tb, F.lit(FRAME_PATTERN), F.lit(2))
    funcs = F.regexp_extract_all(tb, F.lit(FRAME_PATTERN), F.lit(3))
    n = F.size(files)
    return F.when(n > 0, F.struct(F.get(files, n - 1).alias("file"), F.get(nums, n - 1).alias("line"),
                                  F.get(funcs, n - 1).alias("function")))


def module_path(file) -> Column:
    """C14: path after the last '/addons/', else after the last '/odoo/',
    else the base name; '' for ''."""
    f = _c(file)
    return (F.when(F.coalesce(f, F.lit("")) == "", F.lit(""))
            .when(F.instr(f, "/addons/") > 0, F.regexp_extract(f, r"^.*/addons/(.*)$", 1))
            .when(F.instr(f, "/odoo/") > 0, F.regexp_extract(f, r"^.*/odoo/(.*)$", 1))
            .otherwise(F.substring_index(f, "/", -1)))


def normalize_message(message) -> Column:
    """First non-empty line; six ordered rewrites to '<?>'; runs of
    placeholders collapse to one; white space collapsed and trimmed."""
    s = first_non_empty_line(message)
    for pat in MESSAGE_NORMALIZERS:
        s = F.regexp_replace(s, pat, PLACEHOLDER)
    s = F.regexp_replace(s, r"(?:<\?>)+", PLACEHOLDER)
    return trim_ws(F.regexp_replace(s, f"{WS}+", " "))


def error_signature(etype, message, traceback) -> Column:
    """First 16 hex chars of SHA-256 over NUL-joined
    (type, [module path, function], normalised message)."""
    fr = origin_frame(traceback)
    has = fr.isNotNull() & (fr["file"] != "")
    path = F.when(has, module_path(fr["file"]))
    func = F.when(has, fr["function"])
    raw = F.concat_ws("\u0000", _c(etype), path, func, normalize_message(message))
    return F.substring(F.sha2(raw, 256), 1, 16)


def ingest_signature(category, module, model, method) -> Column:
    """category[:module][:model][:method], empty parts skipped."""
    def part(x):
        return F.when(F.coalesce(_c(x), F.lit("")) != "", _c(x))
    return F.concat_ws(":", _c(category), part(module), part(model), part(method))


def legacy_signature(etype, message) -> Column:
    """C16b legacy: SHA-256 of type + ':' + first non-empty line, 16 hex chars."""
    return F.substring(F.sha2(F.concat(_c(etype), F.lit(":"), first_non_empty_line(message)), 256), 1, 16)
