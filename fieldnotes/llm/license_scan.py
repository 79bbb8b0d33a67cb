"""License scan: ordered signature rules behind keyword gates, on native expressions alone.

A text becomes one line of words with one space between them. A rule is a regular expression over whole
words with a label, keywords and a priority. A rule's expression is tried only on lines that hold one of its
keywords, which every match holds. All places of a rule come from split() and regexp_extract_all(): the words between two places and
the words of a place add up to its interval of words. Detections are then resolved: one that lies inside
the interval of another with a higher priority, or of a longer one with the same priority, is suppressed.

Null and empty texts have no words and no places. Repeated rows are scanned each for itself. Column names
of the input that clash with results are replaced in the result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldnotes.llm.base import ascii_lower

#: Fixed phrases of the base detection with their labels.
BASE = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))

#: Families: label, names as a regular expression over words, keywords of the gate (every alternative holds one of
#: them), versions that are written.
FAMILIES = (
    ("gpl", "(?:gnu )?(?:general public license|gpl)", ("general public license", "gpl"), ("1", "2", "3")),
    ("lgpl", "(?:gnu )?(?:lesser|library) general public license|lgpl", ("general public license", "lgpl"), ("2", "2 1", "3")),
    ("agpl", "(?:gnu )?affero general public license|agpl", ("affero general public license", "agpl"), ("1", "3")),
    ("gfdl", "(?:gnu )?free documentation license|gfdl", ("free documentation license", "gfdl"), ("1 1", "1 2", "1 3")),
    ("apache", "apache (?:software )?license|asl", ("apache license", "apache software license", " asl "), ("1", "1 1", "2")),
    ("mit", "(?:the )?mit(?: expat| x11)? license|expat license", ("mit license", "mit x11 license", "expat license"), ()),
    ("bsd", "(?:new |modified |simplified |revised )?bsd(?: style)? license", ("bsd license", "bsd style license"), ()),
    ("bsd-2-clause", "(?:2|two) clause bsd license|bsd (?:2|two) clause", ("clause bsd license", "bsd 2 clause", "bsd two clause"), ()),
    ("bsd-3-clause", "(?:3|three) clause bsd license|bsd (?:3|three) clause", ("clause bsd license", "bsd 3 clause", "bsd three clause"), ()),
    ("bsd-4-clause", "(?:4|four) clause bsd license|bsd (?:4|four) clause", ("clause bsd license", "bsd 4 clause", "bsd four clause"), ()),
    ("0bsd", "zero clause bsd|0bsd", ("zero clause bsd", "0bsd"), ()),
    ("mpl", "mozilla public license|mpl", ("mozilla public license", " mpl "), ("1", "1 1", "2")),
    ("epl", "eclipse public license|epl", ("eclipse public license", " epl "), ("1", "2")),
    ("cpl", "common public license", ("common public license",), ("1",)),
    ("cddl", "common development and distribution license|cddl", ("distribution license", "cddl"), ("1", "1 1")),
    ("eupl", "european union public licen[cs]e|eupl", ("european union public licen", "eupl"), ("1", "1 1", "1 2")),
    ("artistic", "artistic license", ("artistic license",), ("1", "2")),
    ("zlib", "zlib(?: libpng)? license", ("zlib license", "libpng license"), ()),
    ("libpng", "libpng license", ("libpng license",), ("2",)),
    ("isc", "isc license", (" isc license",), ()),
    ("boost", "boost software license", ("boost software license",), ("1",)),
    ("unlicense", "the unlicense|unlicense", ("unlicense",), ()),
    ("wtfpl", "do what the fuck you want to public license|wtfpl", ("you want to public license", "wtfpl"), ("2",)),
    ("ofl", "(?:sil )?open font license|sil ofl", ("open font license", "sil ofl"), ("1", "1 1")),
    ("osl", "open software license", ("open software license",), ("1", "2", "2 1", "3")),
    ("afl", "academic free license", ("academic free license",), ("1 2", "2", "2 1", "3")),
    ("ms-pl", "microsoft public license|ms pl", ("microsoft public license", " ms pl "), ()),
    ("ms-rl", "microsoft reciprocal license|ms rl", ("microsoft reciprocal license", " ms rl "), ()),
    ("python", "python software foundation license|psf license", ("python software foundation license", "psf license"), ("2",)),
    ("php", "php license", ("php license",), ("3", "3 01")),
    ("ruby", "ruby license", ("ruby license",), ()),
    ("postgresql", "postgresql license", ("postgresql license",), ()),
    ("openssl", "openssl license", ("openssl license",), ()),
    ("odbl", "open (?:data commons open )?database license|odbl", ("database license", "odbl"), ("1",)),
    ("odc-by", "open data commons attribution license|odc by", ("open data commons attribution license", "odc by "), ("1",)),
    ("pddl", "public domain dedication and license|pddl", ("public domain dedication and license", "pddl"), ("1",)),
    ("cecill", "cecill(?: license)?", ("cecill",), ("1", "2", "2 1")),
    ("upl", "universal permissive license", ("universal permissive license",), ("1",)),
    ("ncsa", "university of illinois open source license|ncsa license", ("illinois open source license", "ncsa license"), ()),
    ("vim", "vim license", (" vim license",), ()),
    ("beerware", "beerware license|beer ware license", ("beerware license", "beer ware license"), ()),
    ("openrail", "(?:creativeml )?(?:openrail(?: ?m)?(?: license)?|open rail(?: ?m(?: license)?| license))", ("openrail", "open rail"), ()),
    ("bsl", "business source license", ("business source license",), ("1 1",)),
    ("sspl", "server side public license|sspl", ("server side public license", "sspl"), ("1",)),
    ("elastic", "elastic license", ("elastic license",), ("2",)),
    ("cc0", "cc ?0|creative commons zero", (" cc0 ", " cc 0 ", "creative commons zero"), ("1",)),
)
#: Creative Commons terms: label, words after "cc" and words after "creative commons".
CC_TERMS = (
    ("cc-by", "by", "attribution"),
    ("cc-by-sa", "by sa", "attribution share ?alike"),
    ("cc-by-nd", "by nd", "attribution no ?deriv(?:ative)?s?"),
    ("cc-by-nc", "by nc", "attribution non ?commercial"),
    ("cc-by-nc-sa", "by nc sa", "attribution non ?commercial share ?alike"),
    ("cc-by-nc-nd", "by nc nd", "attribution non ?commercial no ?deriv(?:ative)?s?"),
)
#: Keywords of the rules that are made from families and terms.
SPDX, CC, COMMONS = ("spdx license identifier",), (" cc by ",), ("creative commons attribution",)
CC_VERSIONS = ("1 0", "2 0", "2 5", "3 0", "4 0")
#: Statements without a name: label, expression, keywords.
STATEMENTS = (
    ("all-rights-reserved", "all rights reserved", ("all rights reserved",)),
    ("public-domain", "(?:in|into|to) the public domain", ("the public domain",)),
    ("proprietary", "(?:proprietary and confidential|confidential and proprietary)", ("proprietary and", "and proprietary")),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy", ("permission is hereby granted",)),
    ("isc", "permission to use copy modify and or distribute this software for any purpose", ("permission to use",)),
    ("bsd", "redistribution and use in source and binary forms", ("redistribution and use",)),
    ("unlicense", "free and unencumbered software released into the public domain", ("unencumbered",)),
    ("gpl", "either version [0-9]+ of the license or at your option any later version", ("at your option any later version",)),
    ("zlib", "this software is provided as is without any express or implied warranty", ("express or implied warranty",)),
    ("wtfpl", "everyone is permitted to copy and distribute verbatim or modified copies", ("verbatim or modified",)),
    ("unknown-license", "licensed under", ("licensed under",)),
    ("unknown-license", "released under the", ("released under the",)),
    ("unknown-license", "subject to the terms of the", ("subject to the terms",)),
)
#: Substrings that stand for all keywords that hold them in the gate of a line.
STEMS = ("license", "gpl", "creative commons", "bsd")


def signature_rules() -> list[tuple[str, str, tuple[str, ...], int]]:
    """(label, expression, keywords, priority) of all rules, the most telling first. A line on which the expression
    matches holds at least one of the keywords."""
    rules = []
    for label, name, key, versions in FAMILIES:
        name = f"(?:{name})"
        for version in versions:
            major = version.removesuffix(" 0")
            zero = "" if " " in version else "(?: 0)?"
            tag = f"{label}-{version.replace(' ', '.')}"
            later = "or (?:\\(?at your option\\)? )?any later version|or later"
            rules += [
                (f"{tag}-or-later", f"{name} (?:v|version )?{major}{zero} (?:of the license )?(?:{later})", key, 6),
                (tag, f"{name} (?:v |v|version )?{major}{zero}", key, 5),
                (tag, f"spdx license identifier {label.replace('-', ' ')} {major}{zero}", SPDX, 7),
                (tag, f"version {major}{zero} of the {name}", key, 5),
            ]
        rules += [
            (label, f"spdx license identifier {label.replace('-', ' ')}", SPDX, 6),
            (label, f"(?:licensed|released|distributed|available|published|provided) under (?:the |a )?(?:terms of the )?{name}", key, 4),
            (label, name, key, 3),
        ]
    for label, short, long in CC_TERMS:
        for version in CC_VERSIONS:
            tag = f"{label}-{version.replace(' ', '.')}"
            rules += [
                (tag, f"cc {short} {version}", CC, 5),
                (tag, f"creative commons {long} {version}(?: international| unported| generic)?", COMMONS, 5),
                (tag, f"creativecommons org licenses {short} {version}", ("creativecommons org licenses",), 6),
            ]
        rules += [(label, f"cc {short}", CC, 4), (label, f"creative commons {long}", COMMONS, 4)]
    rules += [(label, expression, key, 2 - label.startswith("unknown")) for label, expression, key in STATEMENTS]
    return sorted(rules, key=lambda r: -r[3])


def gate_words(rules: list[tuple[str, str, tuple[str, ...], int]]) -> list[str]:
    """Substrings of which a line holds at least one if it holds a keyword of any rule."""
    return list(dict.fromkeys(next((stem for stem in STEMS if stem in key), key) for rule in rules for key in rule[2]))


def _holds_any(words: list[str] | tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains("_line", F.lit(w)) for w in words])


def word_line(text: Column) -> Column:
    """The words of a text with A-Z lower-cased, one space before, between and after them."""
    return F.concat(
        F.lit(" "),
        F.trim(F.regexp_replace(ascii_lower(F.coalesce(text, F.lit(""))), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " ")),
        F.lit(" "),
    )


def _spaces(c: Column) -> Column:
    return F.length(c) - F.length(F.replace(c, F.lit(" ")))


def _places(line: Column, expression: str, label: str, priority: int, mark: int) -> Column:
    """All places of an expression as (first word, end word, label, priority, mark)."""
    rx = f"(?<= )(?:{expression})(?= )"
    return F.transform(
        F.expr(
            f"filter(aggregate(zip_with(split(`_line`, r'{rx}', -1), regexp_extract_all(`_line`, r'{rx}', 0), (gap, hit) -> "
            "named_struct('gap', coalesce(length(gap) - length(replace(gap, ' ')), 0), 'hit', coalesce(length(hit) - length(replace(hit, ' ')), 0), 'is', hit is not null)), "
            "named_struct('at', 0L, 'all', cast(array() as array<struct<first:bigint,end:bigint>>)), "
            "(s, x) -> named_struct('at', s.at + x.gap + x.hit, 'all', if(x.is, concat(s.all, array(named_struct('first', s.at + x.gap - 1, 'end', s.at + x.gap + x.hit))), s.all)), "
            "s -> s.all), x -> true)"
        ),
        lambda p: F.struct(p["first"].alias("first"), p["end"].alias("end"), F.lit(label).alias("label"), F.lit(priority).alias("priority"), F.lit(mark).alias("base")),
    )


def scan(docs: DataFrame, text: str = "text", gated: bool = True) -> DataFrame:
    """docs with n_words, `places` (base detections, all of them) and `detections` (rules, after suppression);
    both are arrays of (first, end, label, priority, base) with words counted from 0, end exclusive. Without the gates
    every rule is tried on every line, with the same result."""
    kind = "array<struct<first:bigint,end:bigint,label:string,priority:int,base:int>>"
    none = F.expr(f"cast(array() as {kind})")
    frame = docs.drop("n_words", "places", "detections", "_line", "_found").withColumn("_line", word_line(F.col(text)))
    # a line without words is one or two spaces
    frame = frame.withColumn("n_words", F.when(F.trim("_line") == "", F.lit(0)).otherwise(_spaces(F.col("_line")) - 1).cast("long"))
    frame = frame.withColumn(
        "places",
        F.concat(*[F.when(F.contains("_line", F.lit(p)), _places(F.col("_line"), p, label, 9, 1)).otherwise(none) for p, label in BASE]),
    )
    rules = signature_rules()
    by_keys: dict[tuple[str, ...], list] = {}
    for rule in rules:
        by_keys.setdefault(rule[2], []).append(rule)
    tried = []
    for keys, group in by_keys.items():
        places = F.concat(*[_tried(rule) for rule in group]) if len(group) > 1 else _tried(group[0])
        tried.append(F.when(_holds_any(keys), places).otherwise(none) if gated else places)
    found = F.concat(*tried)
    if gated:
        found = F.when(_holds_any(gate_words(rules)), found).otherwise(none)
    # base places are suppressors too and stay; one detection inside a stronger or longer one goes
    frame = frame.withColumn("_found", F.array_distinct(found))
    kept = F.expr(
        "filter(_found, x -> not exists(_found, y -> y.first <= x.first and x.end <= y.end and "
        "(y.priority > x.priority or (y.priority = x.priority and y.end - y.first > x.end - x.first))))"
    )
    return frame.withColumn("detections", kept).drop("_line", "_found")


def _tried(rule: tuple[str, str, str, int]) -> Column:
    label, expression, _, priority = rule
    return _places(F.col("_line"), expression, label, priority, 0)


def license_report(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score. The score grows
    from 0 with the strongest detection (0.1 for each step of priority) and is 1 where a base phrase stands."""
    frame = scan(docs)
    base = F.transform("places", lambda p: p["label"])
    rules = F.transform("detections", lambda p: p["label"])
    strongest = F.array_max(F.transform("detections", lambda p: p["priority"]))
    return frame.select(
        "doc_id",
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min(F.transform("places", lambda p: p["first"])).alias("first_word"),
        F.array_max(F.transform("places", lambda p: p["first"])).alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(base)), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat(base, rules))), ",").alias("labels"),
        F.when(F.size("places") > 0, 1.0).otherwise(F.coalesce(strongest * 0.1, F.lit(0.0))).alias("score"),
        "detections",
    )
