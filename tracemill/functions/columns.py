"""Column expressions: paths, hashes, text shapes, ranges and small scalars. All stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as C


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# --- paths


def language(path) -> Column:
    """typescript, javascript, python or unknown, by the last extension."""
    extension = F.lower(F.regexp_extract(col(path), r"\.([^./]+)$", 1))
    return F.when(extension.isin("ts", "tsx", "mts", "cts"), "typescript").when(extension.isin("js", "jsx", "mjs", "cjs"), "javascript").when(extension == "py", "python").otherwise("unknown")


def language_family(name) -> Column:
    """Languages of one family may be compared with each other."""
    c = col(name)
    return F.when(c.isin("javascript", "typescript"), "script").otherwise(c)


def auxiliary(path, scan: bool = False) -> Column:
    return col(path).rlike(C.AUXILIARY_SCAN_PATH if scan else C.AUXILIARY_PATH)


def derived(path) -> Column:
    return col(path).rlike(C.DERIVED_PATH)


def in_excluded_directory(path, segments=tuple(C.EXCLUDED_SEGMENTS)) -> Column:
    return F.arrays_overlap(F.split(F.lower(col(path)), "/"), F.array(*[F.lit(s) for s in segments]))


def excluded_by(path, rules: list[str]) -> Column:
    """Equal to a rule or inside the directory it names; src/a does not cover src/ab."""
    p, out = col(path), F.lit(False)
    for rule in rules:
        out = out | (p == rule) | p.startswith(rule.rstrip("/") + "/")
    return out


def safe_path(path) -> Column:
    """Relative, plain and at most 512 characters: no empty, . or .. segment, no control character, no \\ : or %."""
    p = col(path)
    shaped = (F.length(p) > 0) & (F.length(p) <= 512) & ~p.rlike(r"[\\:%\x00-\x1f\x7f]") & ~p.startswith("/")
    return F.coalesce(shaped & ~F.exists(F.split(p, "/"), lambda s: s.isin("", ".", "..")), F.lit(False))


def path_priority(path) -> Column:
    """Order in which a file budget is spent: product source first, shallow first, usual roots first."""
    p = col(path)
    return F.when(auxiliary(p, scan=True), 100).otherwise(0) + F.when(p.rlike(r"(?i)^(src|lib|packages|app|pkg)/"), -1).otherwise(0) + F.size(F.split(p, "/"))


def strip_root(path) -> Column:
    return F.regexp_replace(col(path), "^[^/]*/", "")


def relative_path(path) -> Column:
    return F.regexp_replace(F.translate(col(path), "\\", "/"), "^/+", "")


def repository_of(url) -> tuple[Column, Column]:
    """Owner/name of a public https repository address, and the reason for which there is none."""
    u = F.trim(col(url))
    core = r"^https://github\.com/([A-Za-z0-9](?:[A-Za-z0-9-]{0,38}))/([A-Za-z0-9._-]{1,100}?)(?:\.git)?/?$"
    short = r"^([A-Za-z0-9](?:[A-Za-z0-9-]{0,38}))/([A-Za-z0-9._-]{1,100}?)(?:\.git)?$"
    name = F.when(u.rlike(core), F.concat_ws("/", F.regexp_extract(u, core, 1), F.regexp_extract(u, core, 2))).when(u.rlike(short), F.concat_ws("/", F.regexp_extract(u, short, 1), F.regexp_extract(u, short, 2)))
    error = F.when(u.isNull() | (u == ""), "EMPTY").when(u.rlike(r"^[a-z]+://[^/]*@"), "CREDENTIALS").when(name.isNull(), "UNSUPPORTED")
    return F.when(error.isNull(), name), error


# --- text shapes and hashes


def longest_line(source) -> Column:
    return F.coalesce(F.array_max(F.transform(F.split(col(source), "\n"), F.length)), F.lit(0))


def minified(source) -> Column:
    """A line over 1,000 characters, or over 250 per line on average."""
    s = col(source)
    return (longest_line(s) > 1000) | (F.length(s) / F.greatest(F.size(F.split(s, "\n")), F.lit(1)) > 250)


def selection_reason(path, source) -> Column:
    """Why a file stays out of the corpus, the first reason that holds; null for files that enter."""
    p, s = col(path), col(source)
    return (
        F.when(p.rlike(C.SKIPPED_PATH), "excluded_path")
        .when(language(p) == "unknown", "unsupported_type")
        .when(F.octet_length(s) > 100_000, "too_large")
        .when(F.instr(s, "\0") > 0, "binary")
        .when(F.substring(s, 1, 600).rlike(C.GENERATED_HEAD), "generated")
        .when(minified(s), "minified")
    )


def exact_hash(source) -> Column:
    return F.sha2(F.regexp_replace(F.regexp_replace(col(source), "\r\n?", "\n"), "(?m)[ \t]+$", ""), 256)


def shape_hash(kinds) -> Column:
    return F.sha2(F.array_join(col(kinds), "\x01"), 256)


def short_hash(c, n: int = 10) -> Column:
    return F.substring(col(c), 1, n)


def fnv1a32(c) -> Column:
    """FNV-1a of a text over its UTF-16 code units."""
    units = F.transform(F.regexp_extract_all(F.hex(F.encode(col(c), "UTF-16BE")), F.lit(".{4}"), F.lit(0)), lambda x: F.conv(x, 16, 10).cast("bigint"))
    return F.aggregate(units, F.lit(2166136261).cast("bigint"), lambda h, u: (h.bitwiseXOR(u) * F.lit(16777619)).bitwiseAND(F.lit(4294967295)))


def winnow(hashes, window: int) -> Column:
    """(hash, position) of the least hash of every window, rightmost on ties, of an array of hashes of any type.

    For short arrays: the time grows with the square of their length.
    """
    h = col(hashes)
    n = F.size(h)
    last = F.greatest(n - window, F.lit(0))
    pairs = F.transform(h, lambda x, i: F.struct(x.alias("hash"), (-i).alias("back")))
    least = F.transform(F.sequence(F.lit(0), last), lambda s: F.array_min(F.slice(pairs, s + 1, window)))
    return F.transform(F.when(n > 0, F.array_distinct(least)).otherwise(F.slice(pairs, 1, 0)), lambda x: F.struct(x["hash"].alias("hash"), (-x["back"]).alias("position")))


def name_tokens(name) -> Column:
    plain = F.regexp_replace(F.lower(col(name)), "^@[^/]+/", "")
    return F.filter(F.split(plain, "[^a-z0-9]+"), lambda t: F.length(t) > 1)


# --- ranges, excerpts, sentences


def merge_ranges(ranges, gap: int = 1) -> Column:
    """Sorted inclusive (start, end) ranges; those at most gap lines apart become one."""
    one = "struct<start:int,end:int>"
    start = F.array().cast(f"array<{one}>")

    def safe(done, r):
        last = F.try_element_at(done, F.lit(-1))
        joined = F.struct(last["start"].alias("start"), F.greatest(last["end"], r["end"]).alias("end"))
        grown = F.concat(F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0))), F.array(joined))
        return F.when((F.size(done) > 0) & (r["start"] <= last["end"] + gap + 1), grown).otherwise(F.concat(done, F.array(r)))

    return F.aggregate(F.array_sort(col(ranges).cast(f"array<{one}>")), start, safe)


def excerpt(source, start, end, around: int = 1, most_lines: int | None = None, most_chars: int | None = None) -> Column:
    """The lines start..end of a text with some around, cut to a number of lines and characters."""
    lines = F.split(col(source), "\r?\n")
    first = F.greatest(col(start) - around, F.lit(1))
    last = F.least(col(end) + around, F.size(lines))
    n = F.greatest(last - first + 1, F.lit(0))
    out = F.array_join(F.slice(lines, first, F.least(n, F.lit(most_lines)) if most_lines else n), "\n")
    return F.substring(out, 1, most_chars) if most_chars else out


def format_ranges(ranges) -> Column:
    return F.array_join(F.transform(col(ranges), lambda r: F.when(r["start"] == r["end"], r["start"].cast("string")).otherwise(F.concat_ws("–", r["start"].cast("string"), r["end"].cast("string")))), ", ")


def percent(c) -> Column:
    return F.concat(F.floor(col(c) * 100 + 0.5).cast("string"), F.lit("%"))


def escape_html(c) -> Column:
    out = col(c)
    for plain, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        out = F.replace(out, F.lit(plain), F.lit(entity))
    return out


def clean_text(c, most: int) -> Column:
    return F.substring(F.trim(F.regexp_replace(F.regexp_replace(col(c), r"[\x00-\x1f\x7f]", " "), r"\s+", " ")), 1, most)


def integrity_matches(content, integrity) -> Column:
    """Whether the SHA digest written as algorithm-digest (base64 or hex) fits the content; a null one always does."""
    text = col(integrity)
    digest = F.regexp_extract(text, "^sha(?:1|256|384|512)-(.*)$", 1)
    wanted = F.when(digest.rlike("^[0-9a-f]+$"), digest).otherwise(F.lower(F.hex(F.try_to_binary(digest, F.lit("base64")))))
    bits = F.regexp_extract(text, "^sha(1|256|384|512)-", 1)
    have = F.when(bits == "1", F.sha1(col(content))).when(bits == "256", F.sha2(col(content), 256)).when(bits == "384", F.sha2(col(content), 384)).when(bits == "512", F.sha2(col(content), 512))
    return text.isNull() | F.coalesce(have == wanted, F.lit(False))


def purl(ecosystem, name, version) -> Column:
    kind = F.when(col(ecosystem) == "go", "golang").otherwise(col(ecosystem))
    return F.concat(F.lit("pkg:"), kind, F.lit("/"), F.replace(col(name), F.lit("@"), F.lit("%40")), F.when(col(version).isNotNull(), F.concat(F.lit("@"), col(version))).otherwise(""))


def month_start(ts) -> Column:
    return F.date_trunc("month", col(ts))


# --- intake


def intake_reason(path, size, source, rules: list[str], most_bytes: int) -> Column:
    """Why an uploaded file is left out, the first reason that holds; null for files that are taken."""
    p, s = col(path), col(source)
    outside = F.coalesce(in_excluded_directory(p), F.lit(False)) | p.rlike(r"(^|/)\.(git|svn|hg)(/|$)") | p.rlike(r"(?i)\.(min|generated)\.[^.]+$")
    return (
        F.when(excluded_by(p, rules), "user_excluded")
        .when(outside, "excluded_directory")
        .when(p.rlike(r"(?i)\.(zip|tar|gz|tgz|bz2|xz|7z|rar)$"), "nested_archive")
        .when(language(p) == "unknown", "unsupported_type")
        .when(col(size) > most_bytes, "file_too_large")
        .when(s.rlike(r"[\x00-\x08\x0e-\x1f]") | s.startswith("PK\x03\x04"), "binary")
    )


def tree_reason(path, size, rules: list[str], most_bytes: int) -> Column:
    """Why an entry of a repository tree is left out; the order differs from that of uploads."""
    p = col(path)
    return (
        F.when(language(p) == "unknown", "unsupported_type")
        .when(excluded_by(p, rules), "user_excluded")
        .when(F.coalesce(in_excluded_directory(p), F.lit(False)), "excluded_directory")
        .when(F.coalesce(col(size), F.lit(0)) > most_bytes, "file_too_large")
    )


def incomplete(reason) -> Column:
    """Reasons after which a scan did not see all that it should have."""
    return F.coalesce(col(reason).isin("file_too_large", "binary"), F.lit(False))


def last_suffix(path) -> Column:
    """From the last dot of the whole path on, in small letters; empty without one."""
    return F.lower(F.regexp_extract(col(path), r"(\.[^.]*)$", 1))


def ignored_segment(path) -> Column:
    return F.arrays_overlap(F.split(col(path), "/"), F.array(*[F.lit(s) for s in C.IGNORED_SEGMENTS]))


def is_text_file(path) -> Column:
    return last_suffix(path).isin([*C.TEXT_SUFFIXES, ""])


def is_code_file(path) -> Column:
    return last_suffix(path).isin(C.CODE_SUFFIXES)


def exclusion_rules(rules) -> tuple[Column, Column]:
    """Sorted distinct exclusion rules of an array of paths, and whether the array is valid: at most 100, plain and without globs."""
    r = F.transform(col(rules), lambda x: F.regexp_replace(x, "/$", ""))
    sound = F.forall(col(rules), lambda x: F.coalesce(~x.rlike(r"[*?\[\]{}]"), F.lit(False))) & F.forall(r, safe_path)
    valid = F.coalesce((F.size(col(rules)) <= 100) & sound, F.lit(False))
    return F.when(valid, F.array_sort(F.array_distinct(r))), valid


def selection_root(paths) -> Column:
    """The one first directory that all nested paths of an array lie in, null where there are several or none."""
    roots = F.array_distinct(F.transform(F.filter(col(paths), lambda p: F.contains(p, F.lit("/"))), lambda p: F.substring_index(p, "/", 1)))
    return F.when(F.size(roots) == 1, F.element_at(roots, 1))


def repository_input(text) -> Column:
    """A pasted repository address with its scheme and host put in where they were left out."""
    t = F.regexp_replace(F.trim(col(text)), "/+$", "")
    return F.when(t.rlike("(?i)^https?://"), t).when(t.rlike(r"(?i)^github\.com/"), F.concat(F.lit("https://"), t)).when(t.rlike(r"^[\w.-]+/[\w.-]+$"), F.concat(F.lit("https://github.com/"), t)).otherwise(t)


def commit_state(status, message) -> Column:
    """empty_repository for the one answer that says so; anything else stays unknown (null)."""
    return F.when((col(status) == 409) & (col(message) == "Git Repository is empty."), "empty_repository")


def is_private_upload(source_type) -> Column:
    return F.coalesce(col(source_type).isin("zip", "files"), F.lit(False))


def nothing_to_scan(fetched, source_type, empty) -> Column:
    return (col(fetched) == 0) | (is_private_upload(source_type) & F.coalesce(col(empty), F.lit(False)))


def retryable(code) -> Column:
    return F.coalesce(col(code).isin("PROCESSING_TIMEOUT", "SCAN_BUSY"), F.lit(False))
