"""GIF frames, secret scans and licence scans on small fixtures."""

import base64
import hashlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from marea.llm import gif, licenses, secrets

SAMPLE = base64.b64decode("R0lGODlhCgAKAJEAAP////8AAAAA/wAAACH5BAAAAAAALAAAAAAKAAoAAAIWjC2Zhyoc3DOgAnXslfqo3mCMBJFMAQA7")


def test_known_file():
    got = gif.read(SAMPLE)
    assert (got.width, got.height, got.fault) == (10, 10, None)
    assert got.images[0].indexes[:3].tolist() == [[1, 1, 1, 1, 1, 2, 2, 2, 2, 2]] * 3
    row = gif.frames(SAMPLE)[0]
    assert row["rgba"][:4] == b"\xff\x00\x00\xff" and sum(row["histogram"]) == 100


@pytest.mark.parametrize("bits", [2, 5, 8])
def test_code_streams(bits):
    r = np.random.default_rng(bits)
    for data in (b"", b"\0", bytes(70_000), r.integers(0, 1 << bits, 50_000).astype(np.uint8).tobytes(), bytes([1, 2, 3] * 20_000)):
        assert gif.lzw_decode(gif.lzw_encode(data, bits), bits, len(data)) == data


def test_codes_without_clear():
    """A table that is full and not cleared stays as it is."""
    data = np.random.default_rng(1).integers(0, 256, 9_000).astype(np.uint8).tobytes()
    table, codes, prefix = {bytes([i]): i for i in range(256)}, [256], b""
    for b in data:
        if prefix + bytes([b]) in table:
            prefix += bytes([b])
        else:
            codes.append(table[prefix])
            if len(table) < 4096 - 2:
                table[prefix + bytes([b])] = len(table) + 2
            prefix = bytes([b])
    codes += [table[prefix], 257]
    bits, value, at = "", 0, 0
    for j, c in enumerate(codes):
        w = 9 if j == 0 else min(12, (257 + j - 1).bit_length())
        value |= c << at
        at += w
    assert gif.lzw_decode(value.to_bytes(-(-at // 8), "little"), 8, len(data)) == data


def test_rules_of_frames(spark):
    palette = np.array([[255, 0, 0], [0, 255, 0], [0, 0, 255], [9, 9, 9]], dtype=np.uint8)
    g = gif.Gif(3, 2, palette)
    full, dot = np.zeros((2, 3), np.uint8), np.array([[1, 3]], np.uint8)
    g.images = [gif.Image(full, delay=5), gif.Image(dot, 1, 1, 7, 3, transparent=3), gif.Image(dot, 0, 0, 2, 2), gif.Image(np.array([[2]], np.uint8), 2, 0, 1, palette=palette[::-1], interlaced=True)]
    data = gif.write(g)
    df = spark.createDataFrame([(1, data), (2, None), (3, b"nope"), (4, data[:-30]), (5, b"")], "frame_id long, gif binary")
    rows = gif.decode_frames(df, ["frame_id"], "gif").orderBy("frame_id", "frame").collect()
    mine = [r for r in rows if r.frame_id == 1]
    assert [(r.frame, r.start_ms, r.delay_ms, r.disposal) for r in mine] == [(0, 0, 50, 0), (1, 50, 70, 3), (2, 120, 20, 2), (3, 140, 10, 0)]
    pixel = lambda r, x, y: tuple(r.rgba[4 * (y * 3 + x) : 4 * (y * 3 + x) + 4])
    red, green, clear = (255, 0, 0, 255), (0, 255, 0, 255), (0, 0, 0, 0)
    assert (pixel(mine[1], 1, 1), pixel(mine[1], 2, 1)) == (green, red)
    assert (pixel(mine[2], 1, 1), pixel(mine[2], 0, 0), pixel(mine[2], 1, 0)) == (red, green, (9, 9, 9, 255))
    assert (pixel(mine[3], 0, 0), pixel(mine[3], 2, 0), mine[3].transparent) == (clear, green, 2)
    assert sum(mine[3].histogram) == 4
    assert [r.fault for r in rows if r.frame_id == 3] == ["no GIF signature"]
    assert not [r for r in rows if r.frame_id in (2, 5)] and all(r.fault for r in rows if r.frame_id == 4)


def test_store_texts(spark):
    texts = ["", None, "a", "x" * 64, "ñé" * 4000, "word " * 300_000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("feature", F.lit(1))
    for row in gif.store_texts(df).collect():
        raw = (texts[row.doc_id] or "").encode()
        padded = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        assert (row.n_bytes, row.payload_bytes, row.payload_sha256, row.tail_crc32) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))
    assert gif.store_texts(df.limit(0)).count() == 0


def test_secrets(spark):
    live, copied = "9f8e7d6c5b4a39281706f5e4", "q7W8e9R0t1Y2"
    rows = [
        (1, f"x token = {live} and PassWord:'{copied}' api_key=abc", "a", "en"),
        (2, f"secret=\"{copied}\"", "b", "en"),
        (3, f"APIKEY: {copied} AKIA{'A' * 16} AKIAX", "c", "en"),
        (4, None, None, None),
        (5, "", "a", "en"),
        (5, f"token={live}", "a", None),
        (None, "é" * 10 + "secret: aaaaaaaa", "z", "en"),
        (6, "toſen ſecret=abcdefgh passwd=" + "0" * 24, "d", "de"),
    ]
    df = spark.createDataFrame(rows + rows[:1], "doc_id long, text string, source string, lang string").withColumn("kind", F.lit(9))
    got = {(r.doc_id, r.n_assign): r for r in secrets.digest(df).collect()}
    assert secrets.digest(df).count() == len(rows) + 1
    assign = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
    for doc, text, _, _ in rows:
        base = sorted([(m.start(), 0, m.end(), "assign") for m in assign.finditer(text or "") if len(m[2]) >= 6] + [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text or "") if len(m[0]) >= 20] + [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", text or "") if len(m[0]) >= 24])
        r = got[doc, sum(b[1] == 0 for b in base)]
        line = ",".join(f"{k}:{s}:{e}" for s, _, e, k in base)
        assert r.base_sha256 == hashlib.sha256(line.encode()).hexdigest()
        assert set(filter(None, line.split(","))) <= set(r.spans.split(","))
    assert (got[1, 2].n_live, got[1, 2].n_example, got[2, 1].n_example, got[5, 1].n_live, got[None, 1].n_example) == (1, 1, 1, 1, 1)
    assert "live:10:34" in got[1, 2].spans
    assert secrets.digest(df.limit(0)).count() == 0


MIT = """The MIT License (MIT)

Copyright (c) 2020 A. Person
Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.
"""
BSD = """Copyright (c) 2020, A. Person
All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
"""
APACHE = """# Copyright 2020 A. Person
#
# Licensed under the Apache License, Version 2.0 (the "License");
# you may not use this file except in compliance with the License.
# You may obtain a copy of the License at
#
#     http://www.apache.org/licenses/LICENSE-2.0
"""
ISC = """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.
"""


ZLIB = """This software is provided 'as-is', without any express or implied
warranty. In no event will the authors be held liable for any damages
arising from the use of this software.

Permission is granted to anyone to use this software for any purpose,
including commercial applications, and to alter it and redistribute it
freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not
   claim that you wrote the original software. If you use this software
   in a product, an acknowledgment in the product documentation would be
   appreciated but is not required.
"""
WTFPL = """            DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE
                    Version 2, December 2004

 Everyone is permitted to copy and distribute verbatim or modified
 copies of this license document, and changing it is allowed as long
 as the name is changed.

            DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE
   TERMS AND CONDITIONS FOR COPYING, DISTRIBUTION AND MODIFICATION

  0. You just DO WHAT THE FUCK YOU WANT TO.
"""


def gnu(name, version, program="program", mark=";"):
    """The notice as it is published; from version 3 on with a comma before the version."""
    return f"""/*
 * This {program} is free software; you can redistribute it and/or
 * modify it under the terms of the GNU {name}
 * as published by the Free Software Foundation{mark} either version {version}
 * of the License, or (at your option) any later version.
 */
"""


def test_licenses(spark):
    rows = [
        (1, "Foo bar.\nReleased under the MIT License.\nx", "mit-release", "MIT"),
        (2, "Licensed under the Apache License, Version 2.0.", "apache-licensed", "Apache-2.0"),
        (3, "Permission is hereby granted", "", "NONE"),
        (4, "This program is free software: x. This program is free software", "gpl-free,gpl-free", "UNKNOWN"),
        (5, None, "", "NONE"),
        (6, "Licensed under CC BY-NC 4.0! " + "word. " * 5000 + "All rights reserved.", "cc-by-nc-4-0-0,reserved", "CC-BY-NC-4.0,Proprietary"),
        (7, "prose of a line\nReleased under the MIT License\nmore prose", "mit-release", "MIT"),
    ]
    df = spark.createDataFrame([r[:2] for r in rows] * 2, "doc_id long, text string").withColumn("id", F.lit("x"))
    assert sorted((r.doc_id, r.sentence_ids, r.license) for r in licenses.recognise(df).collect()) == sorted([(d, s, n) for d, _, s, n in rows] * 2)


def test_licence_files(spark):
    """Texts as they stand in files: wrapped, commented, after titles and copyright lines, several in one."""
    endorse = "3. Neither the name of the copyright holder nor the names of its contributors\n   may be used to endorse or promote products derived from this software without\n   specific prior written permission.\n"
    rows = [
        (MIT, "MIT"), (BSD, "Proprietary,BSD-2-Clause"), (BSD + endorse, "Proprietary,BSD-3-Clause"), (APACHE, "Apache-2.0"), (ISC, "ISC"),
        (gnu("General Public License", 3, mark=","), "GPL-3.0-or-later"), (gnu("General Public License", 2), "GPL-2.0-or-later"),
        (gnu("Lesser General Public License", "2.1", "library"), "LGPL-2.1-or-later"), (gnu("Affero General Public License", 3, mark=","), "AGPL-3.0-or-later"),
        (APACHE + "\n" + MIT, "Apache-2.0,MIT"),
        ("// SPDX-License-Identifier: Apache-2.0\nint main() {}\n", "Apache-2.0"), ("/* SPDX-License-Identifier: GPL-2.0-or-later */", "GPL-2.0-or-later"), ("# spdx-license-identifier: MIT", "MIT"),
        ("This project is licensed under the MIT License - see the LICENSE file for details", "MIT"),
        ("The parts below are licensed under the MIT license and nothing else, all rights reserved", "MIT,Proprietary"),
        (ZLIB, "Zlib"), (WTFPL, "WTFPL"), ("This module is distributed under the terms of the Artistic License 2.0.", "Artistic-2.0"),
        (gnu("General Public License", 2).replace("either version 2\n * of the License, or (at your option) any later version.", "version 2 of the License."), "GPL-2.0-only"),
        ("A licence to print software.", "NONE"), ("this program is free software", "UNKNOWN"),
    ]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "doc_id long, text string")
    got = {r.doc_id: r.license for r in licenses.recognise(df).collect()}
    assert [got[i] for i in range(len(rows))] == [n for _, n in rows]
    import duckdb

    documents = df.toPandas()  # noqa: F841
    con = duckdb.connect()
    con.register("documents", documents)
    assert {r[0]: r[3] for r in con.sql(licenses.sql()).fetchall()} == got


def test_every_known_sentence_has_a_trigger():
    assert all(any(t in w for t in licenses.TRIGGERS for w in s.split()) for s in licenses.SENTENCES.values())
    assert {i for _, _, ids in licenses.RULES for i in ids.split(",")} <= set(licenses.SENTENCES)


def test_hostile_gif_and_clashing_keys(spark):
    small = gif.pack(bytes(range(256)) * 64)
    huge = b"GIF89a" + (32767).to_bytes(2, "little") * 2 + bytes([0x70, 0, 0]) + b"\x2c" + bytes(4) + (1).to_bytes(2, "little") * 2 + b"\x00\x02\x00\x3b"
    df = spark.createDataFrame([(1, small), (2, huge), (3, None)], "frame long, gif binary")
    rows = gif.decode_frames(df, ["frame"]).collect()
    assert [(r.key_frame, r.fault) for r in rows if r.key_frame == 2] == [(2, "canvas too large")]
    mine = sorted((r for r in rows if r.key_frame == 1), key=lambda r: r.frame)
    assert [(r.disposal, r.delay_ms) for r in mine] == [(1, 40), (2, 50), (3, 60), (1, 40)] and {sum(r.histogram) for r in mine} == {64 * 64}
    both = spark.createDataFrame([(7, 8, 9, small)], "frame long, key_frame long, the_file long, gif binary")
    one = gif.decode_frames(both, ["frame", "key_frame", "the_file"]).first()
    assert (one.key_key_frame, one.key_frame, one.the_file, one.frame) == (7, 8, 9, 0)
    # equal frames: the second shows what stands there already
    assert gif.unpack(gif.pack(b"ab" * 4096))[2:] == (2, 1)
