"""The same results in SQL, for the queries whose method SQL can express on whole tables."""

from __future__ import annotations

import re

from .licenses import _MARK, PHRASE_SCORE, PHRASES, TEMPLATES

_WORD = r"[^\x20\x09-\x0D]+"

#: A checksum by its definition, a bit at a time.
_CRC32 = "xor(4294967295, list_reduce(flatten(list_transform(string_split(doc_id::varchar, ''), lambda c: [ord(c)::bigint, -1, -1, -1, -1, -1, -1, -1, -1])), lambda now, x: case when x >= 0 then xor(now, x) when now % 2 = 1 then xor(now // 2, 3988292384) else now // 2 end, 4294967295))"

OP11 = rf"""with t as (select row_number() over () k, doc_id, regexp_extract_all(coalesce(text, ''), '{_WORD}') w, {_CRC32} h from documents),
p as (select *, cast(len(w) as bigint) n, h // 10 g from t),
q as (select *, g % greatest(n, 1) a from p),
e as (select k, doc_id, n, case when h % 10 = 0 and n > 0 then list_transform(range(n), lambda i: case when i < a then w[i + 1] else w[a + (i - a) % (1 + (n - a) // (3 + g % 8)) + 1] end) else w end w from q),
word as (select k, n, unnest(w) x, generate_subscripts(w, 1) - 1 i from e),
pair as (select a.k, a.i, b.i - a.i q from word a join word b on a.k = b.k and a.x = b.x and b.i > a.i where 2 * (b.i - a.i) <= a.n),
isle as (select k, q, min(i) s, count(*) + q len from (select *, i - row_number() over (partition by k, q order by i) isle from pair) group by k, q, isle having count(*) + q >= greatest(12, 2 * q)),
run as (select k, s, len, min(q) q from isle group by k, s, len),
said as (select k, count(*) n_runs, string_agg(s || ',' || len || ',' || q || chr(10), '' order by s, q) lines, arg_min([s, len, q], [-len, s, q]) best from run group by k),
gone as (select distinct word.k, word.i from word join run on run.k = word.k and word.i >= run.s + run.q and word.i < run.s + run.len),
kept as (select word.k, string_agg(x, ' ' order by word.i) words from word anti join gone on gone.k = word.k and gone.i = word.i group by word.k)
select doc_id, coalesce(n_runs, 0) n_runs, cast(best[1] as bigint) as start, cast(best[2] as bigint) as length, cast(best[3] as bigint) as period, cast(1000 * best[2] // best[3] as bigint) exponent_milli, sha256(coalesce(lines, '')) runs_sha256, sha256(coalesce(words, '')) collapsed_sha256
from e left join said on said.k = e.k left join kept on kept.k = e.k"""


def _pattern(template: str) -> tuple[str, list[tuple[str, int]]]:
    """A template as a regular expression over words with a space before each, and the expression and mandatory words of each of its clauses' ends."""
    out, depth, total, ends = "", 0, 0, []
    for m in _MARK.finditer(template):
        if (m[0] in "[]" or m[1]) and not depth and total:
            ends.append((out, total))
        if m[0] == "[":
            out, depth = out + "(?:", depth + 1
        elif m[0] == "]":
            out, depth = out + ")?", depth - 1
        elif m[1]:
            out += f"(?: [^ ]+){{{m[1]},{m[2]}}}"
        else:
            out += " " + re.escape(m[0])
            total += not depth
    return out, [(p, n / total) for p, n in [*ends, (out, total)]]


def license_sql() -> str:
    """Phrases by their words' places, templates as regular expressions."""
    starts = ", ".join("list_filter(range(1, len(w) + 1), lambda i: " + " and ".join(f"w[i + {j}] = '{x}'" for j, x in enumerate(phrase.split())) + f") as {label}_at" for phrase, label in PHRASES.items())
    every = "list_concat(" + ", ".join(f"{label}_at" for label in PHRASES.values()) + ")"
    labels, share = ", ".join(f"case when len({label}_at) > 0 then '{label}' end" for label in PHRASES.values()), ["0.0"]
    own = []
    for label, template in TEMPLATES:
        whole, ends = _pattern(template)
        own.append(f"case when regexp_matches(s, '{whole} ') then '{label}' end")
        share += [f"case when regexp_matches(s, '{p} ') then {n!r}::double else 0.0 end" for p, n in ends]
    joined = lambda x: f"array_to_string(list_sort(list_distinct(list_filter([{x}], lambda x: x is not null))), ',')"
    return rf"""with t as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from documents),
p as (select *, ' ' || array_to_string(w, ' ') || ' ' s, {starts} from t)
select doc_id, cast(len(w) as bigint) n_words, cast(len({every}) as bigint) n_base, cast(list_min({every}) - 1 as bigint) first_word, cast(list_max({every}) - 1 as bigint) last_word, {joined(labels)} base_labels, {joined(labels + ", " + ", ".join(own))} as labels,
greatest({", ".join(share)}, case when len({every}) > 0 then {PHRASE_SCORE} else 0 end) as score from p"""


_BITS = {"A": 1, "B": 2, "C": 4, "D": 8, "E": 16}

OP13 = rf"""with recursive d as (select doc_id, coalesce(lang, '') part, coalesce(text, '') txt, regexp_extract_all(coalesce(text, ''), '{_WORD}') w from documents),
m as (select doc_id, part, case when len(w) < 200 then 1 else 0 end + case when 100 * len(list_distinct(w)) < 50 * len(w) then 2 else 0 end
+ case when 100 * (length(txt) - length(regexp_replace(txt, '[A-Z]', '', 'g'))) > 3 * length(txt) then 4 else 0 end + case when regexp_matches(txt, '[#$%&*|]') then 8 else 0 end
+ case when doc_id > min(doc_id) over (partition by txt) then 16 else 0 end mask from d),
l as (select doc_id, max(quality = 1) good, max(toxic = 1) toxic from labels group by doc_id),
c as (select part, mask, coalesce(good, false) good, coalesce(toxic, false) toxic, count(*) n from m left join l using (doc_id) group by all),
f as (select * from (values {", ".join(f"('{x}', {b})" for x, b in _BITS.items())}) v(x, bit)),
o as (select '' so_far, 0 seen, '' x, 0 bit, 0 step, 0 earlier union all select so_far || f.x, seen + f.bit, f.x, f.bit, step + 1, seen from o join f on seen & f.bit = 0 where step < 5),
s as (select a.so_far filter_order, b.step, b.bit, b.earlier from o a join o b on a.step = 5 and b.step > 0 and starts_with(a.so_far, b.so_far)),
r as (select part, filter_order, step, bit, sum(case when mask & (bit | earlier) = 0 then n else 0 end) kept, sum(case when mask & bit > 0 and mask & earlier = 0 then n else 0 end) removed, sum(case when mask & bit > 0 and mask & earlier > 0 then n else 0 end) redundant,
sum(case when mask = bit then n else 0 end) unique_fails, sum(case when mask & bit > 0 and mask & earlier = 0 and good then n else 0 end) good_lost, sum(case when mask & bit > 0 and mask & earlier = 0 and toxic then n else 0 end) toxic_lost from c, s group by all)
select part, filter_order, step, kept::bigint kept, removed::bigint removed, redundant::bigint redundant, unique_fails::bigint unique_fails, good_lost::bigint good_lost, toxic_lost::bigint toxic_lost, cast(sum(removed) over (partition by part, bit) as bigint) shapley from r"""

ORACLES = {"op11_periodic_runs": OP11, "op12_license_scan": license_sql(), "op13_filter_audit": OP13}
