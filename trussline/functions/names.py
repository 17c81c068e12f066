"""Names, error texts and fingerprints as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What differs between two runs of one failure, in the order in which it is replaced.
VOLATILE = (
    (r"[0-9]{4}-[0-9]{2}-[0-9]{2}[T ][0-9]{2}:[0-9]{2}:[0-9]{2}(\.[0-9]+)?([+-][0-9]{2}:?[0-9]{2}|Z)?", "<ts>"),
    (r"[0-9]{4}-[0-9]{2}-[0-9]{2}", "<date>"),
    (r"/(tmp|var/folders)/[^ \t\r\n'\"<>]+", "/tmp/<x>"),
    (r"\b[0-9a-fA-F]{8,}\b", "<hex>"),
    (r":[0-9]+", ":<n>"),
    (r"\b0x[0-9a-fA-F]+\b", "<addr>"),
)
#: Parts of a field's name that tell its category; the first category with a part in the name is taken.
CATEGORIES = (
    ("displacement", ("DISP", "DEPL", "RVNODDIS")),
    ("reaction", ("REAC", "RF", "RVFORCES")),
    ("stress", ("STRESS", "SIGMA", "SIEF", "RVSTRESS")),
    ("strain", ("STRAIN", "EPSI", "EPS")),
)


def extension(key: Column) -> Column:
    """Lower-case extension, '' where there is none."""
    return F.lower(F.regexp_extract(key, r"\.([^.]+)$", 1))


def stable_text(message: Column) -> Column:
    for pattern, mark in VOLATILE:
        message = F.regexp_replace(message, pattern, mark)
    return message


def last_line(text: Column) -> Column:
    """The last line with a character that isn't white space, without white space at its end (nor at its start, where it is the only one); '' where there is none."""
    lines = F.filter(F.split(stripped(F.coalesce(text, F.lit(""))), "\r\n|[\n\r\\x0b\\x0c]"), lambda x: stripped(x) != "")
    return F.when(F.size(lines) > 0, F.regexp_replace(F.element_at(lines, -1), r"\s+$", "")).otherwise("")


def stripped(text: Column) -> Column:
    """Without white space of any kind at the ends."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def failure_fingerprint(source_ext: Column, target: Column, message: Column, traceback: Column) -> Column:
    """16 hex digits: equal for failures of one kind of conversion whose message and last traceback line differ in nothing that lasts."""
    kinds = [F.lower(stripped(F.coalesce(c, F.lit("")))) for c in (source_ext, target)]
    return fingerprint(*kinds, stable_text(stripped(F.coalesce(message, F.lit("")))), stable_text(last_line(traceback)))


def fingerprint(*parts: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 16)


def safe_name(name: Column, no_dot: bool = False) -> Column:
    """A name that solvers take: no leading slash, other slashes as underscores, no '=', not starting with a digit."""
    bare = F.replace(F.replace(F.regexp_replace(name, "^/", ""), F.lit("/"), F.lit("_")), F.lit("="), F.lit(""))
    bare = F.when(bare.rlike("^[0-9]"), F.concat(F.lit("_"), bare)).otherwise(bare)
    return F.trim(F.replace(bare, F.lit("."), F.lit("_")) if no_dot else bare)


def safe_identifier(name: Column) -> Column:
    """Letters, digits and underscores, without an extension and not starting with a digit; 'case' where nothing is left."""
    stem = F.regexp_replace(F.regexp_replace(name, r"^.*/", ""), r"(.)\.[^.]*$", "$1")
    clean = F.regexp_replace(stem, "[^A-Za-z0-9_]", "_")
    return F.when(clean == "", "case").when(clean.rlike("^[0-9]"), F.concat(F.lit("_"), clean)).otherwise(clean)


def public_key(scope: Column, key: Column) -> Column:
    """Keys of a corpus are shown by a hash; those of other scopes as scope/key."""
    hidden = F.concat(scope, F.lit("/file-"), F.substring(F.sha2(key, 256), 1, 10))
    plain = F.when((scope != "") & (key != ""), F.concat_ws("/", scope, key)).when(key != "", key).otherwise(scope)
    return F.when(scope.startswith("corpus:"), hidden).otherwise(plain)


def scope_token(kind: Column, scope_id: Column) -> Column:
    """shared, user:<id>, project:<id> or corpus:<id>; another kind as it is, none as shared."""
    kind, own = F.trim(F.coalesce(kind, F.lit(""))), F.trim(F.coalesce(scope_id, F.lit("")))
    return F.when(kind.isin("user", "project", "corpus"), F.concat_ws(":", kind, own)).when(kind == "", "shared").otherwise(kind)


def field_category(name: Column) -> Column:
    """displacement, reaction, stress, strain or other: the first that the name has a part of."""
    n, out = F.upper(name), None
    for category, parts in CATEGORIES:
        has = F.lit(False)
        for p in parts:
            has = has | n.contains(p)
        out = F.when(has, category) if out is None else out.when(has, category)
    return out.otherwise("other")


def layer_label(layer: Column) -> Column:
    """An integration point's layer by the sign of its height; mid where it has none."""
    return F.when(layer > 0, "top").when(layer < 0, "bottom").otherwise("mid")
