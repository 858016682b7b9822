"""Licences: text detection, the two normalisers, policy, manifests and the bill of materials."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import purl

# fixed values: patterns by licence, the first that fits decides
SIGNATURES = [
    ("AGPL-3.0", r"(?i)GNU AFFERO GENERAL PUBLIC LICENSE|\bAGPL-3\.0"),
    ("GPL-3.0", r"(?i)GNU GENERAL PUBLIC LICENSE\s*Version 3|\bGPL-3\.0"),
    ("GPL-2.0", r"(?i)GNU GENERAL PUBLIC LICENSE\s*Version 2|\bGPL-2\.0"),
    ("LGPL-3.0", r"(?i)GNU LESSER GENERAL PUBLIC LICENSE\s*Version 3|\bLGPL-3\.0"),
    ("LGPL-2.1", r"(?i)GNU LESSER GENERAL PUBLIC LICENSE\s*Version 2\.1|\bLGPL-2\.1"),
    ("MPL-2.0", r"(?i)Mozilla Public License,?\s*version 2\.0|\bMPL-2\.0"),
    ("Apache-2.0", r"(?i)Apache License,?\s*Version 2\.0|\bApache-2\.0"),
    ("BSD-3-Clause", r"(?i)Redistribution and use in source and binary forms|3-Clause"),
    ("BSD-2-Clause", r"(?i)2-Clause BSD"),
    ("ISC", r"(?i:Permission to use, copy, modify, and/?or distribute this software)|\bISC\b"),
    ("Unlicense", r"(?i)This is free and unencumbered software released into the public domain"),
    ("MIT", r"(?i)Permission is hereby granted, free of charge|\bMIT License\b"),
]
# fixed values: names of licence files, policy by licence, licences from the most permissive on
LICENSE_FILES = ["LICENSE", "LICENSE.md", "LICENSE.txt", "COPYING", "NOTICE"]
POLICY = {"CLEAR": ["MIT", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "ISC", "Unlicense"], "REVIEW": ["MPL-2.0", "LGPL-2.1", "LGPL-3.0"], "BLOCKING": ["GPL-2.0", "GPL-3.0", "AGPL-3.0"]}
PERMISSIVENESS = ["Unlicense", "MIT", "ISC", "BSD-2-Clause", "BSD-3-Clause", "Apache-2.0", "MPL-2.0", "LGPL-2.1", "LGPL-3.0", "GPL-2.0", "GPL-3.0", "AGPL-3.0"]
# fixed values: spellings of the plain identifiers
PLAIN = {i.lower(): i for i in PERMISSIVENESS} | {
    "mit license": "MIT",
    "apache 2.0": "Apache-2.0",
    "apache license 2.0": "Apache-2.0",
    "apache license, version 2.0": "Apache-2.0",
    "apache software license": "Apache-2.0",
    "isc license": "ISC",
    "the unlicense": "Unlicense",
}
# fixed values: registry spellings by identifier
REGISTRY = {
    "MIT": ["mit", "mit license", "the mit license", "expat"],
    "ISC": ["isc", "isc license", "isc license (iscl)"],
    "Apache-2.0": ["apache", "apache 2", "apache 2.0", "apache-2", "apache-2.0", "apache license 2.0", "apache license, version 2.0", "apache software license", "apache2", "asl 2.0"],
    "BSD-3-Clause": ["bsd", "bsd license", "new bsd", "new bsd license", "bsd-3-clause", "3-clause bsd", "bsd 3-clause", "modified bsd"],
    "BSD-2-Clause": ["bsd-2-clause", "simplified bsd", "freebsd"],
    "0BSD": ["0bsd"],
    "GPL-3.0-or-later": ["gpl", "gpl-3.0-or-later", "gplv3+", "gnu general public license v3 or later (gplv3+)"],
    "GPL-3.0-only": ["gplv3", "gpl-3.0", "gpl-3.0-only", "gnu gpl v3", "gnu general public license v3 (gplv3)"],
    "GPL-2.0-or-later": ["gpl-2.0-or-later", "gplv2+", "gnu general public license v2 or later (gplv2+)"],
    "GPL-2.0-only": ["gplv2", "gpl-2.0", "gpl-2.0-only", "gnu general public license v2 (gplv2)"],
    "LGPL-3.0-or-later": ["lgpl", "lgpl-3.0-or-later"],
    "LGPL-3.0-only": ["lgpl-3.0", "lgpl-3.0-only", "lgplv3", "gnu lesser general public license v3 (lgplv3)"],
    "LGPL-2.1-or-later": ["lgpl-2.1-or-later", "gnu lesser general public license v2 or later (lgplv2+)"],
    "LGPL-2.1-only": ["lgpl-2.1", "lgpl-2.1-only"],
    "AGPL-3.0-or-later": ["agpl-3.0-or-later", "gnu affero general public license v3 or later (agplv3+)"],
    "AGPL-3.0-only": ["agpl-3.0", "agpl-3.0-only", "agplv3", "gnu affero general public license v3"],
    "MPL-2.0": ["mpl-2.0", "mpl 2.0", "mozilla public license 2.0 (mpl 2.0)"],
    "EPL-2.0": ["epl-2.0"],
    "Unlicense": ["unlicense", "the unlicense (unlicense)"],
    "CC0-1.0": ["cc0-1.0", "cc0"],
    "WTFPL": ["wtfpl"],
    "Zlib": ["zlib"],
    "PSF-2.0": ["python software foundation license", "psf", "psf-2.0"],
    "BlueOak-1.0.0": ["blueoak-1.0.0"],
    "Artistic-2.0": ["artistic-2.0"],
    "BSL-1.0": ["bsl-1.0"],
    "HPND": ["hpnd"],
}
# fixed value: identifiers of copyleft licences
COPYLEFT = r"^(A?GPL|LGPL|MPL|EPL|CDDL|EUPL|OSL|SSPL)"


def _lookup(table: dict[str, str], key: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[key]


def detect(text) -> Column:
    """The licence whose signature a text carries, in fixed order; Unknown without one."""
    c = F.col(text) if isinstance(text, str) else text
    out = F.when(c.rlike(SIGNATURES[0][1]), SIGNATURES[0][0])
    for name, pattern in SIGNATURES[1:]:
        out = out.when(c.rlike(pattern), name)
    return out.otherwise("Unknown")


def is_license_file(path) -> Column:
    return F.substring_index(path, "/", -1).isin(LICENSE_FILES)


def policy(license) -> Column:
    c = F.col(license) if isinstance(license, str) else license
    out = F.when(c.isin(POLICY["CLEAR"]), "CLEAR")
    for status in ("REVIEW", "BLOCKING"):
        out = out.when(c.isin(POLICY[status]), status)
    return out.otherwise("UNKNOWN")


def worst_policy(status) -> Column:
    """Aggregate: BLOCKING, else REVIEW, else UNKNOWN if nothing is CLEAR, else CLEAR; nothing at all is CLEAR."""
    c = F.col(status) if isinstance(status, str) else status
    has = lambda s: F.coalesce(F.bool_or(c == s), F.lit(False))
    return F.when(has("BLOCKING"), "BLOCKING").when(has("REVIEW"), "REVIEW").when(has("UNKNOWN") & ~has("CLEAR"), "UNKNOWN").otherwise("CLEAR")


def plain_license(raw) -> Column:
    """One known identifier of a registry string: of an OR the most permissive, of an AND the most restrictive."""
    c = F.trim(F.col(raw) if isinstance(raw, str) else raw)
    c = F.regexp_replace(c, r"^\((.*)\)$", "$1")

    def single(x: Column) -> Column:
        key = F.regexp_replace(F.regexp_replace(F.lower(F.trim(F.regexp_replace(F.trim(x), r"^\(+|\)+$", ""))), "-(only|or-later)$", ""), r"\+$", "")
        return F.coalesce(_lookup(PLAIN, key), F.lit("Unknown"))

    ranks = {n: i for i, n in enumerate(PERMISSIVENESS)}
    order = F.create_map(*[F.lit(x) for kv in ranks.items() for x in kv])
    names = F.array(*[F.lit(n) for n in PERMISSIVENESS])
    options = F.transform(F.filter(F.transform(F.split(c, r"(?i)\sOR\s"), single), lambda x: x != "Unknown"), lambda x: order[x])
    parts = F.transform(F.split(c, r"(?i)\sAND\s"), single)
    either = F.coalesce(F.try_element_at(names, F.array_min(options) + 1), F.lit("Unknown"))
    both = F.when(F.array_contains(parts, "Unknown"), "Unknown").otherwise(F.element_at(names, F.array_max(F.transform(parts, lambda x: F.coalesce(order[x], F.lit(0)))) + 1))
    out = F.when(c.rlike(r"(?i)\sOR\s"), either).when(c.rlike(r"(?i)\sAND\s"), both).otherwise(single(c))
    return F.when(c.isNull() | (c == ""), "Unknown").otherwise(out)


def registry_license(values) -> Column:
    """struct<spdx, raw, family> of an array of registry strings; the structure of expressions is kept."""
    aliases = {a: i for i, names in REGISTRY.items() for a in names}

    def one(x: Column) -> Column:
        t = F.trim(x)
        t = F.trim(F.when(t.rlike(r"^\(.*\)$"), F.regexp_replace(t, r"^\((.*)\)$", "$1")).otherwise(t))
        plausible = t.rlike(r"^[A-Za-z0-9.+-]+$") & (F.length(t) <= 40)
        return F.coalesce(_lookup(aliases, F.lower(t)), F.when(plausible, t))

    def value(v: Column) -> Column:
        text = F.when(v.rlike("^License :: (OSI Approved :: )?.+$"), F.regexp_replace(v, "^License :: (OSI Approved :: )?", "")).otherwise(v)
        inner = F.regexp_replace(text, r"^\((.*)\)$", "$1")
        words = F.regexp_extract_all(inner, F.lit(r"\s+(OR|AND|WITH)\s+"), F.lit(1))
        ids = F.transform(F.split(inner, r"\s+(?:OR|AND|WITH)\s+"), one)
        joined = F.array_join(F.zip_with(ids, words, lambda a, b: F.concat_ws(" ", a, b)), " ")
        whole = F.when(F.exists(ids, lambda i: i.isNull()), F.when(F.length(text) <= 60, one(text))).otherwise(F.trim(joined))
        skipped = v.rlike("(?i)^see license in|^unlicensed$") | text.rlike("(?i)^OSI Approved$")
        return F.when(~skipped, whole)

    kept = F.filter(F.col(values) if isinstance(values, str) else values, lambda v: F.coalesce(F.length(v) > 0, F.lit(False)))
    ids = F.array_distinct(F.array_compact(F.transform(kept, value)))
    spdx = F.when(F.size(ids) > 0, F.array_join(ids, " OR "))
    copyleft = F.forall(F.split(spdx, " OR "), lambda alt: F.exists(F.split(alt, " (?:AND|WITH) "), lambda i: i.rlike(COPYLEFT)))
    family = F.when(spdx.isNull(), "unknown").when(copyleft, "copyleft").otherwise("permissive")
    return F.struct(spdx.alias("spdx"), F.when(F.size(kept) > 0, F.array_join(kept, " | ")).alias("raw"), family.alias("family"))


def dependencies(manifests: DataFrame) -> DataFrame:
    """(scan_id, ecosystem, name, version, nth) declared in manifests (scan_id, path, content); the first of a name wins.

    Malformed JSON declares nothing; lock files and pyproject are recognised elsewhere and not read.
    """
    base = F.substring_index("path", "/", -1)
    rows = manifests.select("scan_id", base.alias("base"), "content")
    section = lambda name: F.map_entries(F.from_json(F.get_json_object("content", f"$.{name}"), "map<string,string>"))
    empty = F.array().cast("array<struct<key:string,value:string>>")
    both = F.concat(F.coalesce(section("dependencies"), empty), F.coalesce(section("devDependencies"), empty))
    npm = rows.where("base = 'package.json'").select("scan_id", F.lit(0).alias("o"), F.posexplode(both).alias("i", "e")).select("scan_id", "o", "i", F.lit("npm").alias("ecosystem"), F.col("e.key").alias("name"), F.col("e.value").alias("version"))

    def lines(name: str, order: int, text: Column, pattern: str, ecosystem: str, version: int, skip: str | None = None) -> DataFrame:
        each = rows.where(F.col("base") == name).select("scan_id", F.posexplode(F.split(text, "\n")).alias("i", "raw")).withColumn("line", F.regexp_replace("raw", r"^\s+|\s+$", ""))
        each = each.where(F.col("line").rlike(pattern) & (~F.col("line").startswith(skip) if skip else F.lit(True)))
        found = F.regexp_extract("line", pattern, version)
        return each.select("scan_id", F.lit(order).alias("o"), "i", F.lit(ecosystem).alias("ecosystem"), F.regexp_extract("line", pattern, 1).alias("name"), F.when(found != "", found).alias("version"))

    section_of_cargo = F.regexp_extract("content", r"(?is)\[dependencies\](.*?)(?:\n\[|$)", 1)
    found = (
        npm.unionByName(lines("requirements.txt", 1, F.regexp_replace("content", "#[^\n]*", ""), r"^([A-Za-z0-9._-]+)\s*(==|>=|<=|~=|>|<)?\s*([A-Za-z0-9.]*)", "pypi", 3))
        .unionByName(lines("go.mod", 2, F.col("content"), r"^([a-zA-Z0-9.\-_/]+)\s+(v[\d.]+\S*)", "go", 2, "module"))
        .unionByName(lines("Cargo.toml", 3, section_of_cargo, r"^([A-Za-z0-9_-]+)\s*=\s*\"?([\w.]*)\"?", "cargo", 2))
    )
    first = found.groupBy("scan_id", "ecosystem", "name").agg(F.min(F.struct("o", "i", "version")).alias("f"))
    return first.select("scan_id", "ecosystem", "name", F.col("f.version").alias("version"), (F.col("f.o") * 1_000_000 + F.col("f.i")).alias("nth"))


def bill_of_materials(deps: DataFrame) -> DataFrame:
    """(scan_id, sbom): a CycloneDX 1.5 document per scan, components in declaration order."""
    component = F.struct("nth", F.struct(F.lit("library").alias("type"), "name", "version", purl("ecosystem", "name", "version").alias("purl")).alias("c"))
    per = deps.groupBy("scan_id").agg(F.transform(F.array_sort(F.collect_list(component)), lambda x: x["c"]).alias("components"))
    return per.select("scan_id", F.to_json(F.struct(F.lit("CycloneDX").alias("bomFormat"), F.lit("1.5").alias("specVersion"), F.lit(1).alias("version"), "components")).alias("sbom"))
