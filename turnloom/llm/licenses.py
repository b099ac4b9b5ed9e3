"""License scans: Dice coefficient over word bigrams between windows of a text and templates.

A text's words are its runs of a-z and 0-9 in lower case, so line ends, comment marks and lists do not
count.  Templates are whole published licenses and the notices that stand for them.  A window of a
template's length, or ``STRETCH`` times as long or short, is compared by the Dice coefficient of the
two sets of word bigrams; ``dice >= THETA`` is a hit.  Such a window has between
``THETA / (2 - THETA)`` and ``(2 - THETA) / THETA`` times the template's bigrams: windows of other
sizes, as at the end of a text, are pruned.  It shares at least the former share of the template's
bigrams, so that of the template's *anchors*, one more bigram than may be missing, at least one is in
it: windows are only laid where an anchor is, so that both fall together, and texts without an anchor
are passed over.  Anchors are the bigrams of the longest words, which prose has least.

The anchors and the templates' bigrams are tables of a fixed size; texts with an anchor are written
once as words, the others only as ids.

Edge cases: null and empty texts, and texts of fewer than two words, have no license; equal Dice values
are ordered by template name; repeated rows repeat their result; an empty table gives no rows; other
columns are not read.
"""

from __future__ import annotations

import math
import re
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from turnloom.llm.store import materialize
from turnloom.llm.words import let

THETA, STRETCH = 0.8, 1.25
TEXTS = Path(__file__).parent / "license_texts"

#: Notices as published.
NOTICES: dict[str, str] = {
    "agpl-3.0-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope "
        "that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. "
        "See the GNU Affero General Public License for more details. You should have received a copy of the GNU Affero General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."
    ),
    "all-rights-reserved": "All rights reserved.",
    "apache-2.0-header": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        'software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. '
        "See the License for the specific language governing permissions and limitations under the License."
    ),
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "bsd-notice": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "cc-by-4.0-notice": "Licensed under CC BY 4.0.",
    "cc-by-nc-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "cc-by-sa-4.0-notice": "Licensed under CC BY-SA 4.0.",
    "gpl-2.0-header": (
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation; either version 2 of the License, or (at your option) any later version. This program is distributed in the hope "
        "that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. "
        "See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program; "
        "if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA."
    ),
    "gpl-2.0-notice": "This work is licensed under the GNU General Public License, version 2.",
    "gpl-3.0-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope "
        "that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. "
        "See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."
    ),
    "gpl-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "lgpl-2.1-header": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by "
        "the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. This library is distributed in the hope "
        "that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. "
        "See the GNU Lesser General Public License for more details."
    ),
    "mit-notice": "Released under the MIT License.",
    "mpl-2.0-header": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, "
        "You can obtain one at http://mozilla.org/MPL/2.0/."
    ),
}


def templates(folder: Path = TEXTS) -> dict[str, str]:
    """The notices and the license texts of a folder, by name."""
    return NOTICES | {f.stem: f.read_text(encoding="utf-8") for f in sorted(folder.glob("*.txt"))}


TEMPLATES = templates()


class Template:
    """A template's words, distinct bigrams and anchors with their places."""

    def __init__(self, name: str, text: str, theta: float = THETA):
        self.name, self.words = name, re.findall("[a-z0-9]+", text.lower())
        pairs = [f"{a} {b}" for a, b in zip(self.words, self.words[1:], strict=False)]
        place = {p: i for i, p in reversed(list(enumerate(pairs)))}
        self.bigrams = sorted(place)
        share = theta / (2 - theta)
        may_miss = len(self.bigrams) - math.ceil(share * len(self.bigrams) - 1e-9)
        rare = sorted(self.bigrams, key=lambda p: (-min(map(len, p.split())), -len(p), p))
        self.anchors = sorted((p, place[p]) for p in rare[: may_miss + 1])
        self.lengths = sorted({max(2, round(len(self.words) * f)) for f in (1 / STRETCH, 1, STRETCH)})
        self.least, self.most = share * len(self.bigrams) - 1e-9, len(self.bigrams) / share + 1e-9


def prepared(texts: dict[str, str], theta: float = THETA) -> list[Template]:
    return [t for t in (Template(k, v, theta) for k, v in sorted(texts.items())) if t.bigrams]


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+", -1), lambda w: w != "")


def _bigram(w: Column, i: Column) -> Column:
    return F.concat(F.get(w, i), F.lit(" "), F.get(w, i + 1))


def _anchored(w: Column, anchors: list[str]) -> Column:
    """Places and bigrams of all anchors among a text's words; their longer words are looked for first."""
    long = sorted({max(a.split(), key=len) for a in anchors})
    places = F.filter(F.sequence(F.lit(0), F.size(w) - 2), lambda i: _bigram(w, i).isin(anchors))
    none = F.array().cast("array<struct<p:int,bigram:string>>")
    some = F.transform(places, lambda i: F.struct(i.alias("p"), _bigram(w, i).alias("bigram")))
    return F.when(F.exists(w, lambda x: x.isin(long)) & (F.size(w) > 1), some).otherwise(none)


def license_rows(docs: DataFrame, texts: dict[str, str] = TEMPLATES, theta: float = THETA) -> tuple[DataFrame, DataFrame]:
    """(row, doc_id) of every document, and (row, name, dice) of the best window of each template found in it."""
    spark, ready = docs.sparkSession, prepared(texts, theta)
    names = sorted({p for t in ready for p, _ in t.anchors})
    w = words_of(F.coalesce("text", F.lit("")))
    found = let(w, lambda x: let(_anchored(x, names), lambda a: F.struct(F.when(F.size(a) > 0, x).alias("words"), a.alias("anchors"))))
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", found.alias("f")).select("row", "doc_id", "f.words", "f.anchors")
    rows = materialize(rows, "licenses")
    # tables as large as the templates
    of_anchor = F.broadcast(spark.createDataFrame([(p, k, o, n) for k, t in enumerate(ready) for p, o in t.anchors for n in t.lengths], "bigram string, t int, o int, len int"))
    of_template = F.broadcast(spark.createDataFrame([(k, t.name, t.bigrams, t.least, t.most) for k, t in enumerate(ready)], "t int, name string, bigrams array<string>, least double, most double"))
    n = F.size("words")
    at = rows.where(n > 1).select("row", n.alias("n"), F.explode("anchors").alias("a")).select("row", "n", "a.*").join(of_anchor, "bigram")
    start = F.greatest(F.least(F.col("p") - F.col("o"), F.col("n") - F.col("len")), F.lit(0))
    windows = at.groupBy("row").agg(F.collect_set(F.struct("t", start.alias("s"), "len")).alias("windows"))
    pairs = lambda x: F.array_distinct(F.transform(F.sequence(F.lit(0), F.size(x) - 2), lambda i: _bigram(x, i)))
    cut = F.transform("windows", lambda c: F.struct(c["t"].alias("t"), let(F.slice("words", c["s"] + 1, c["len"]), pairs).alias("mine")))
    seen = rows.select("row", "words").join(windows, "row").select("row", F.explode(cut).alias("c")).select("row", "c.*").join(of_template, "t")
    size = F.size("mine")
    seen = seen.where(size.between(F.col("least"), F.col("most")))
    dice = 2.0 * F.size(F.array_intersect("mine", "bigrams")) / (size + F.size("bigrams"))
    hits = seen.select("row", "name", dice.alias("dice")).where(F.col("dice") >= theta).groupBy("row", "name").agg(F.max("dice").alias("dice"))
    return rows.select("row", "doc_id"), hits


def license_scan(docs: DataFrame, texts: dict[str, str] = TEMPLATES, theta: float = THETA) -> DataFrame:
    """doc_id, licenses (names in order, comma-joined), best_license, best_dice."""
    rows, hits = license_rows(docs, texts, theta)
    best = hits.groupBy("row").agg(F.array_join(F.sort_array(F.collect_list("name")), ",").alias("licenses"), F.min_by(F.struct("name", "dice"), F.struct(-F.col("dice"), "name")).alias("b"))
    return rows.join(best, "row", "left").select("doc_id", F.coalesce("licenses", F.lit("")).alias("licenses"), F.col("b.name").alias("best_license"), F.round("b.dice", 6).alias("best_dice"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licenses named or quoted in all documents."""
    return license_scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _sql() -> str:
    quoted = lambda xs: "[" + ", ".join(f"'{x}'" for x in xs) + "]"
    ready = prepared(TEMPLATES)
    values = ", ".join(f"({k}, '{t.name}', {quoted(t.bigrams)}, {t.least!r}::double, {t.most!r}::double)" for k, t in enumerate(ready))
    anchors = ", ".join(f"('{p}', {k}, {o}, {n})" for k, t in enumerate(ready) for p, o in t.anchors for n in t.lengths)
    return rf"""
with templates(t, name, bigrams, least, most) as (values {values}),
anchors(bigram, t, o, len) as (values {anchors}),
d as (select row_number() over () as row, doc_id, coalesce(text, '') as text from documents),
tokens as (select row, regexp_extract_all(lower(text), '[a-z0-9]+') as w from d),
grams as (select row, len(w) as n, unnest(range(len(w) - 1)) as p, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) as bigram from tokens where len(w) > 1),
windows as (select distinct row, t, len, greatest(least(p - o, n - len), 0) as s from grams join anchors using (bigram)),
pieces as (
  select t, row, list_distinct(list_transform(range(1, len(x)), lambda i: x[i] || ' ' || x[i + 1])) as mine
  from (select t, row, w[s + 1:s + windows.len] as x from windows join tokens using (row))
), scored as (
  select row, name, 2.0::double * len(list_intersect(mine, bigrams)) / (len(mine) + len(bigrams)) as dice from pieces join templates using (t) where len(mine) between least and most
), hits as (
  select row, name, max(dice) as dice from scored where dice >= {THETA} group by row, name
), best as (
  select row, string_agg(name, ',' order by name) as licenses, list(name order by dice desc, name)[1] as best_license, max(dice) as best_dice from hits group by row
)
select doc_id, coalesce(licenses, '') as licenses, best_license, round(best_dice, 6) as best_dice from d left join best using (row)
"""


OP9_SQL = _sql()
