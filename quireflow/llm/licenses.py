"""License scans by conditional compression.

Method. Blocks of text that hold a cue word are compressed with zstandard, once alone and once with each license template as a raw
dictionary, blocks and templates both as words in lower case with one blank between them. The bytes that a template saves, as a share
of what the block costs alone, rank the templates. Whatever their rank, they are confirmed by wording: the template's words are aligned
with the block's, and a template is found if at most ``MOST_DIFFERENT`` of its words are missing or have other words between them, never
mind what stands before and after, and no word with a digit (a version) is missing. Only a template of whose words the block lacks more
than that, in any order, is not aligned, as it can't be found.

Blocks. Texts are cut into blocks of ``BLOCK_WORDS`` words that overlap by half, at a small scale for notices and at a large one for whole
licenses. Half of a block is more than the templates of its scale are long, so every occurrence lies whole in some block, and that
block holds its cue; blocks without a cue are left out. Texts of any length are read whole. What stands between words (blanks, line
breaks, marks of comments) counts for nothing.

Scale. One pass over the texts without a shuffle; texts without a cue never reach Python. Work is linear in the text with a cue.

Edge cases. Null or empty text: no rows. A license found in several blocks of a document is one row with its best block. Ties in saving go
to the name that sorts first. Repeated rows give repeated rows. A null id stays null. Extra columns are ignored.
"""

from __future__ import annotations

import bisect
import difflib
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quireflow.llm.common import texts

BLOCK_WORDS, MOST_DIFFERENT = (32, 256), 0.15
CUE = r"(?i)licen[sc]e|copyright|spdx|warrant|redistribut|permission|public[\W_]+domain|\bCC[\W_]|all[\W_]+rights[\W_]+reserved"

# The wording of public licenses and of the notices that refer to them.
TEMPLATES = {
    "MIT notice": "Released under the MIT License.",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "Apache-2.0 notice": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "BSD-3-Clause": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "GPL-3.0 notice": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "GPL-2.0": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "LGPL-2.1": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "CC-BY-4.0 notice": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0 notice": "Licensed under CC BY-SA 4.0.",
    "CC-BY-NC-4.0 notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC-BY-NC-4.0": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
}
_WORD = re.compile(r"[^\W_]+(?:[.-][^\W_]+)*")
_CUE = re.compile(CUE)
_VERSION = re.compile(r"-.*\d")


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def blocks_of(text: str, sizes: tuple[int, ...] = BLOCK_WORDS) -> Iterator[list[str]]:
    """The words of the blocks of each scale that hold a cue."""
    text = text.lower()
    cues = [m.start() for m in _CUE.finditer(text)]
    if not cues:
        return
    spans = [m.span() for m in _WORD.finditer(text)]
    begins = [s[0] for s in spans]
    held = {bisect.bisect_right(begins, c) - 1 for c in cues}
    for size in sizes:
        half = size // 2
        for k in sorted({max(0, w // half - back) for w in held for back in (0, 1)}):
            yield [text[a:b] for a, b in spans[k * half : k * half + size]]


class Compressed:
    """What blocks cost with and without each template."""

    def __init__(self, templates: dict[str, str]):
        import zstandard

        self.alone = zstandard.ZstdCompressor(level=3)
        self.given = {n: zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(" ".join(words_of(t)).encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)) for n, t in templates.items()}

    def savings(self, block: list[str]) -> list[tuple[int, float, str]]:
        """(bytes saved, share of the cost alone, template), best first."""
        raw = " ".join(block).encode("utf-8", "surrogatepass")
        alone = len(self.alone.compress(raw))
        saved = [(alone - len(c.compress(raw)), n) for n, c in self.given.items()]
        return sorted(((s, s / alone, n) for s, n in saved), key=lambda x: (-x[0], x[2]))


def differences(template: list[str], block: list[str]) -> tuple[int, list[str]]:
    """How many words differ where the template stands in the block, and which: "-" missing, "+" put in between."""
    matcher = difflib.SequenceMatcher(None, template, block, autojunk=False)
    whole = matcher.find_longest_match()
    # what stands before and after the template is none of its business: look no further than its length from the longest match
    low = max(0, whole.b - whole.a - len(template) // 4)
    high = min(len(block), whole.b + len(template) - whole.a + len(template) // 4)
    steps = difflib.SequenceMatcher(None, template, block[low:high], autojunk=False).get_opcodes()
    out: list[str] = []
    for kind, a, b, c, d in steps:
        if kind == "equal":
            continue
        out += [f"-{w}" for w in template[a:b]]
        if 0 < a and b < len(template):
            out += [f"+{w}" for w in block[low + c : low + d]]
    return len(out), out


def _scanner(templates: dict[str, str]):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compressed, wording = Compressed(templates), {n: words_of(t) for n, t in templates.items()}
        most = {n: MOST_DIFFERENT * len(w) for n, w in wording.items()}
        needed = {n: Counter(w) for n, w in wording.items()}
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                best: dict[str, tuple] = {}
                for words in blocks_of(text):
                    have = Counter(words)
                    possible = {n for n, w in needed.items() if sum((w - have).values()) <= most[n]}
                    for rank, (saved, share, name) in enumerate(compressed.savings(words) if possible else (), 1):
                        if name not in possible:
                            continue
                        n, which = differences(wording[name], words)
                        if n <= most[name] and not any(_VERSION.match(w) for w in which):
                            row = (doc, name, saved, share, rank, n, which)
                            if name not in best or (n, -saved) < (best[name][5], -best[name][2]):
                                best[name] = row
                rows += [best[n] for n in sorted(best)]
            if rows:
                kinds = (pa.int64(), pa.string(), pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.list_(pa.string()))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["doc_id", "license", "saved_bytes", "saved_share", "rank", "n_different", "differences"])

    return run


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, str] | None = None) -> DataFrame:
    """One row per document and license found: doc_id, license, saved_bytes, saved_share, rank, n_different, differences."""
    cued = texts(df, id_col, text_col).where(F.col("text").rlike(CUE))
    return cued.mapInArrow(_scanner(templates or TEMPLATES), "doc_id long, license string, saved_bytes long, saved_share double, rank long, n_different long, differences array<string>")
