"""License scans by sentence rules.

Comment signs at the heads of lines go, and a text is cut into sentences at marks, at dashes between words and at blank
lines, so wrapped lines stay together. Each sentence is normalised, and the known licence sentences that it holds are its
identifiers: those that no longer known one of the same sentence holds, in their order. The identifiers of a text, in
order, are matched against ordered licence rules: of each family the first rule that matches names the licence. A text, and
a sentence, without any word of TRIGGERS holds no known sentence and is passed by.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Comment signs, where sentences end (a mark before white space or the end, a dash between words, a blank line), and characters of no word.
SIGNS, CUT, REST = r"(?m)^[ \t]*(?://+|/?\*+/?|#+|;+|--+|%+|<!--|rem )[ \t]?", r"[.!?;:]+(?:[ \t\r\f\n]+|$)|[ \t]+-+[ \t]+|\n[ \t\r\f]*\n", "[^a-z0-9]+"
#: A tag whose colon ends no sentence.
TAG = "(?i)(spdx-license-identifier):[ \t]*"
#: Every known sentence has a word that holds one of these.
TRIGGERS = ("licens", "software", "redistribution", "mpl", "copyright", "domain", "reserved", "warranty")

# Identifiers and normalised sentences (lower case, letters and digits, single spaces) of public licences.
SENTENCES = {
    "mit-release": "released under the mit license",
    "mit-licensed": "licensed under the mit license",
    "mit-terms": "licensed under the terms of the mit license",
    "mit-this": "this project is licensed under the mit license",
    "mit-subject": "subject to the mit license",
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "mit0-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so",
    "mit-notice": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "as-is": "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    "mit-liable": "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    "isc-grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "isc-grant-and": "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "zero-bsd-grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
    "isc-warranty": "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness",
    "bsd-redistribution": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd-source": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "bsd-binary": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "bsd-endorse": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "bsd-advertising": "all advertising materials mentioning features or use of this software must display the following acknowledgement",
    "bsd-licensed": "licensed under the bsd license",
    "bsd-3-licensed": "licensed under the bsd 3 clause license",
    "bsd-2-licensed": "licensed under the bsd 2 clause license",
    "bsd-style": "use of this source code is governed by a bsd style license that can be found in the license file",
    "apache-licensed": "licensed under the apache license version 2 0",
    "apache-licensed-the-license": "licensed under the apache license version 2 0 the license",
    "apache-released": "released under the apache license version 2 0",
    "apache-may-not": "you may not use this file except in compliance with the license",
    "apache-obtain": "you may obtain a copy of the license at",
    "apache-obtain-url": "you may obtain a copy of the license at http www apache org licenses license 2 0",
    "apache-unless": "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "apache-see": "see the license for the specific language governing permissions and limitations under the license",
    "gpl-free": "this program is free software",
    "lgpl-free": "this library is free software",
    "gpl-file-free": "this file is free software",
    "gpl-hope": "this program is distributed in the hope that it will be useful but without any warranty",
    "mpl-terms": "this source code form is subject to the terms of the mozilla public license v",
    "mpl-terms-2": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "mpl-copy": "if a copy of the mpl was not distributed with this file you can obtain one at",
    "epl-terms-2": "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0",
    "epl-terms-1": "this program and the accompanying materials are made available under the terms of the eclipse public license v1 0",
    "boost-distributed": "distributed under the boost software license version 1 0",
    "boost-grant": "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following",
    "zlib-grant": "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions",
    "zlib-origin": "the origin of this software must not be misrepresented you must not claim that you wrote the original software",
    "zlib-origin-cut": "the origin of this software must not be misrepresented",
    "wtfpl": "everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed as long as the name is changed",
    "wtfpl-terms": "the terms of the do what the fuck you want to public license",
    "artistic-title": "the artistic license 2 0",
    "artistic-licensed": "licensed under the artistic license 2 0",
    "artistic-terms": "the terms of the artistic license 2 0",
    "cc0": "licensed under cc0 1 0",
    "cc0-dedicated": "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work",
    "public-domain": "this work is in the public domain",
    "public-domain-placed": "this file has been placed in the public domain",
    "unlicense": "this is free and unencumbered software released into the public domain",
    "unlicense-anyone": "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means",
    "reserved": "all rights reserved",
}

# Families, licences and the sequences of identifiers that make them; of a family the first that matches counts.
RULES = [
    ("mit", "MIT", "mit-grant,mit-notice"),
    ("mit", "MIT", "mit-grant"),
    ("mit", "MIT-0", "mit0-grant"),
    ("isc", "ISC", "isc-grant"),
    ("isc", "ISC", "isc-grant-and"),
    ("isc", "0BSD", "zero-bsd-grant"),
    ("bsd", "BSD-4-Clause", "bsd-redistribution,bsd-source,bsd-binary,bsd-advertising"),
    ("bsd", "BSD-3-Clause", "bsd-redistribution,bsd-source,bsd-binary,bsd-endorse"),
    ("bsd", "BSD-2-Clause", "bsd-redistribution,bsd-source,bsd-binary"),
    ("apache", "Apache-2.0", "apache-licensed-the-license,apache-may-not,apache-obtain"),
    ("mpl", "MPL-2.0", "mpl-terms"),
    ("mpl", "MPL-2.0", "mpl-terms-2"),
    ("epl", "EPL-2.0", "epl-terms-2"),
    ("epl", "EPL-1.0", "epl-terms-1"),
    ("boost", "BSL-1.0", "boost-grant"),
    ("boost", "BSL-1.0", "boost-distributed"),
    ("zlib", "Zlib", "zlib-grant"),
    ("wtfpl", "WTFPL", "wtfpl"),
    ("wtfpl", "WTFPL", "wtfpl-terms"),
    ("artistic", "Artistic-2.0", "artistic-licensed"),
    ("artistic", "Artistic-2.0", "artistic-terms"),
    ("artistic", "Artistic-2.0", "artistic-title"),
    ("cc0", "CC0-1.0", "cc0"),
    ("cc0", "CC0-1.0", "cc0-dedicated"),
    ("apache", "Apache-2.0", "apache-licensed-the-license"),
    ("apache", "Apache-2.0", "apache-licensed"),
    ("apache", "Apache-2.0", "apache-released"),
    ("mit", "MIT", "mit-release"),
    ("mit", "MIT", "mit-licensed"),
    ("mit", "MIT", "mit-terms"),
    ("mit", "MIT", "mit-this"),
    ("mit", "MIT", "mit-subject"),
    ("bsd", "BSD-3-Clause", "bsd-3-licensed"),
    ("bsd", "BSD-2-Clause", "bsd-2-licensed"),
    ("bsd", "BSD", "bsd-licensed"),
    ("bsd", "BSD", "bsd-style"),
    ("public", "Unlicense", "unlicense"),
    ("public", "Public-Domain", "public-domain"),
    ("public", "Public-Domain", "public-domain-placed"),
    ("reserved", "Proprietary", "reserved"),
]


def _add_families() -> None:
    """Sentences and rules of the licences that differ in a name and a version only."""
    gnu = (("GPL", "gnu general public license", ("2", "3")), ("LGPL", "gnu lesser general public license", ("2.1", "3")), ("LGPL", "gnu library general public license", ("2",)), ("AGPL", "gnu affero general public license", ("3",)))
    for short, name, versions in gnu:
        for v in versions:
            said, full = v.replace(".", " "), v if "." in v else f"{v}.0"
            terms = f"you can redistribute it and or modify it under the terms of the {name}"
            kinds = {
                "later": f"{terms} as published by the free software foundation either version {said} of the license or at your option any later version",
                "only": f"{terms} as published by the free software foundation version {said} of the license",
                "kernel": f"{terms} version {said} as published by the free software foundation",
                "work": f"this work is licensed under the {name} version {said}",
                "licensed": f"licensed under the {name} version {said}",
            }
            for kind, sentence in kinds.items():
                key = f"{name.split()[1][:7]}-{said.replace(' ', '-')}-{kind}"
                SENTENCES[key] = sentence
                # licences of one text may differ in version, so each is a family of its own
                RULES.insert(9, (f"{short}-{full}", f"{short}-{full}" + {"later": "-or-later", "only": "-only", "kernel": "-only"}.get(kind, ""), key))
        # as the older ones are published, a semicolon stands before the version
        SENTENCES[f"{name.split()[1][:7]}-terms"] = f"you can redistribute it and or modify it under the terms of the {name} as published by the free software foundation"
        for v in versions:
            said, full = v.replace(".", " "), v if "." in v else f"{v}.0"
            SENTENCES[f"either-{said.replace(' ', '-')}"] = f"either version {said} of the license or at your option any later version"
            SENTENCES[f"version-{said.replace(' ', '-')}"] = f"version {said} of the license"
            for kind, suffix in (("either", "-or-later"), ("version", "-only")):
                RULES.insert(9, (f"{short}-{full}", f"{short}-{full}{suffix}", f"{name.split()[1][:7]}-terms,{kind}-{said.replace(' ', '-')}"))
    tags = ["MIT", "MIT-0", "ISC", "0BSD", "Apache-2.0", "MPL-2.0", "BSL-1.0", "Zlib", "WTFPL", "CC0-1.0", "Unlicense", "Artistic-2.0", "EPL-1.0", "EPL-2.0", *(f"BSD-{i}-Clause" for i in (2, 3, 4))]
    tags += [f"{x}{kind}" for x in ("GPL-2.0", "GPL-3.0", "LGPL-2.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0") for kind in ("", "-only", "-or-later")]
    for tag in tags:
        SENTENCES[f"tag-{tag.lower()}"] = "spdx license identifier " + tag.lower().replace("-", " ").replace(".", " ")
        RULES.append((f"tag-{tag.lower()}", tag, f"tag-{tag.lower()}"))
    for kind in ("by", "by-sa", "by-nd", "by-nc", "by-nc-sa", "by-nc-nd"):
        for v in ("2.0", "2.5", "3.0", "4.0"):
            words = f"cc {kind} {v}".replace("-", " ").replace(".", " ")
            names = {"by": "attribution", "sa": "sharealike", "nd": "noderivatives", "nc": "noncommercial"}
            long = " ".join(names[x] for x in kind.split("-"))
            for i, sentence in enumerate((f"licensed under {words}", f"this work is licensed under a creative commons {long} {v.replace('.', ' ')} international license", f"licensed under a creative commons {long} {v.replace('.', ' ')} license")):
                key = f"cc-{kind}-{v.replace('.', '-')}-{i}"
                SENTENCES[key] = sentence
                RULES.insert(9, ("cc", f"CC-{kind.upper()}-{v}", key))


_add_families()


def sentence_ids(text: Column) -> Column:
    """The identifiers of the known sentences of a text, in order; no text: none."""
    table = F.array(*(F.struct(F.lit(f" {s} ").alias("s"), F.lit(n).alias("n")) for n, s in sorted(SENTENCES.items())))
    some = lambda s: reduce(Column.__or__, (F.contains(s, F.lit(t)) for t in TRIGGERS))
    none = F.expr("cast(array() as array<string>)")

    def found(s):
        whole = F.concat(F.lit(" "), F.trim(F.regexp_replace(s, REST, " ")), F.lit(" "))
        met = F.filter(table, lambda k: F.contains(whole, k["s"]))
        longest = F.filter(met, lambda k: ~F.exists(met, lambda o: (o["s"] != k["s"]) & F.contains(o["s"], k["s"])))
        placed = F.array_sort(F.transform(longest, lambda k: F.struct(F.call_function("instr", whole, k["s"]).alias("at"), k["n"].alias("n"))))
        return F.transform(placed, lambda k: k["n"])

    bare = F.regexp_replace(F.regexp_replace(F.lower(text), TAG, "$1 "), SIGNS, "")
    heavy = F.flatten(F.transform(F.filter(F.split(bare, CUT), some), found))
    return F.when(some(F.lower(text)), heavy).otherwise(none)


def licences(sequence: Column, rules: list[tuple[str, str, str]] | None = None) -> Column:
    """The licences whose identifiers stand in a row in the comma-joined sequence, in its order and comma-joined: of each
    family the first rule that matches. UNKNOWN if none, NONE without sentences."""
    rules = RULES if rules is None else rules
    table = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(f).alias("family"), F.lit(n).alias("name"), F.lit(f",{ids},").alias("ids")) for i, (f, n, ids) in enumerate(rules)))
    line = F.concat(F.lit(","), sequence, F.lit(","))
    met = F.filter(table, lambda r: F.contains(line, r["ids"]))
    first = F.filter(met, lambda r: ~F.exists(met, lambda o: (o["family"] == r["family"]) & (o["i"] < r["i"])))
    ordered = F.array_sort(F.transform(first, lambda r: F.struct(F.call_function("instr", line, r["ids"]).alias("at"), r["i"].alias("i"), r["name"].alias("name"))))
    names = F.array_join(F.transform(ordered, lambda r: r["name"]), ",")
    return F.when(sequence == "", "NONE").when(names == "", "UNKNOWN").otherwise(names)


def recognise(docs: DataFrame) -> DataFrame:
    """doc_id, n_known, sentence_ids (comma-joined) and license of each row of docs (doc_id, text). One pass, no shuffle.

    Null and empty texts have no sentences (NONE); repeated rows and null ids give a row each; other columns are not
    looked at. Known sentences without a rule give UNKNOWN.
    """
    ids = docs.select("doc_id", sentence_ids(F.col("text")).alias("ids"))
    found = ids.select("doc_id", F.size("ids").cast("long").alias("n_known"), F.array_join("ids", ",").alias("sentence_ids"))
    return found.select("*", licences(F.col("sentence_ids")).alias("license"))


def sql() -> str:
    """The same over table documents in DuckDB's SQL."""
    table = ", ".join(f"('{s}', '{n}')" for n, s in SENTENCES.items())
    rules = ", ".join(f"({i}, '{f}', '{n}', ',{ids},')" for i, (f, n, ids) in enumerate(RULES))
    return f"""
WITH known(sentence, id) AS (VALUES {table}),
rules(i, family, name, ids) AS (VALUES {rules}),
bare AS (SELECT row_number() OVER () AS r, doc_id, regexp_replace(regexp_replace(lower(coalesce(text, '')), '{TAG}', '\\1 ', 'g'), '{SIGNS}', '', 'g') AS t FROM documents),
cut AS (SELECT r, unnest(string_split_regex(t, '{CUT}')) AS s, generate_subscripts(string_split_regex(t, '{CUT}'), 1) AS i FROM bare WHERE regexp_matches(t, '{'|'.join(TRIGGERS)}')),
norm AS (SELECT r, i, ' ' || trim(regexp_replace(s, '{REST}', ' ', 'g')) || ' ' AS whole FROM cut WHERE regexp_matches(s, '{'|'.join(TRIGGERS)}')),
held AS (SELECT whole, ' ' || sentence || ' ' AS sentence, id FROM (SELECT DISTINCT whole FROM norm), known WHERE contains(whole, ' ' || sentence || ' ')),
longest AS (SELECT whole, id, instr(whole, sentence) AS j FROM held h WHERE NOT EXISTS (SELECT 1 FROM held o WHERE o.whole = h.whole AND o.sentence <> h.sentence AND contains(o.sentence, h.sentence))),
hits AS (SELECT r, i, j, id FROM norm JOIN longest USING (whole)),
ids AS (SELECT r, count(*) AS n_known, string_agg(id, ',' ORDER BY i, j, id) AS sentence_ids FROM hits GROUP BY r),
met AS (SELECT ids.r, rules.i, name, instr(',' || sentence_ids || ',', rules.ids) AS place, row_number() OVER (PARTITION BY ids.r, family ORDER BY rules.i) AS turn FROM ids JOIN rules ON contains(',' || sentence_ids || ',', rules.ids)),
named_licences AS (SELECT r, string_agg(name, ',' ORDER BY place, i) AS license FROM met WHERE turn = 1 GROUP BY r)
SELECT doc_id, coalesce(n_known, 0) AS n_known, coalesce(sentence_ids, '') AS sentence_ids, CASE WHEN sentence_ids IS NULL THEN 'NONE' ELSE coalesce(license, 'UNKNOWN') END AS license
FROM bare LEFT JOIN ids USING (r) LEFT JOIN named_licences USING (r)"""
