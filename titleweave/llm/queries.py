"""One query for each operator of this subpackage, over its whole table, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from titleweave.llm import bpe, chat, decontam, langid, linededup, simhash, substring, tokenfile, toxicity, winnow
from titleweave.llm.common import table
from titleweave.llm.linededup import LONG, RUN


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op2_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfile.write_and_read(table(spark, sf_dir, "documents"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.report(table(spark, sf_dir, "documents"))


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnow.edited(table(spark, sf_dir, "documents"))


def op8_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and conversation -1, whose texts look like marks."""
    text = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-1, 0, "user", text), (-1, 1, "assistant", text)], "conv_id long, turn long, role string, text string")
    return chat.report(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.report(table(spark, sf_dir, "documents"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_simhash_near_dedup, op2_token_output, op3_substring_dedup, op4_benchmark_decontamination, op5_bpe_round_trip, op6_toxicity, op7_document_fingerprints, op8_chat_formatting, op9_line_dedup, op10_language_id)}


#: A-Z and a-z of the oracles: DuckDB's lower() would change other letters too.
_LOWER = "translate({x}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

OP3 = """
with d as (select row_number() over () rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') w from documents),
g as (select rid, doc_id, i, array_to_string(list_slice(w, i, i + 12), ' ') g from d, unnest(range(1, greatest(len(w) - 11, 1))) u(i)),
m as (select g, min(doc_id) f from g group by g having count(*) > 1),
gone as (select distinct rid, unnest(range(i, i + 13)) i from g join m using (g) where doc_id > f),
x as (select rid, count(*) n from gone group by rid),
l as (select rid, unnest(w) word, generate_subscripts(w, 1) i from d),
kept as (select rid, string_agg(word, ' ' order by i) t from l anti join gone using (rid, i) group by rid)
select doc_id, cast(len(w) as bigint) n_words, coalesce(n, 0) n_removed, sha256(coalesce(t, '')) kept_sha256
from d left join x using (rid) left join kept using (rid)
"""

OP4 = f"""
with d as (select doc_id, row_number() over () rid, regexp_extract_all({_LOWER.format(x="coalesce(text, '')")}, '{_ALNUM}') w from documents),
b as (select coalesce(cast(item_id as varchar), '') item, regexp_extract_all({_LOWER.format(x="coalesce(text, '')")}, '{_ALNUM}') w from benchmark),
bw as (select distinct item, n, array_to_string(list_slice(w, i, i + n - 1), ' ') g
       from (select item, w, least(13, len(w)) n from b where len(w) > 0), unnest(range(1, len(w) - n + 2)) u(i)),
ns as (select distinct n from bw),
dw as (select rid, n, i, array_to_string(list_slice(w, i, i + n - 1), ' ') g from d cross join ns, unnest(range(1, greatest(len(w) - n + 2, 1))) u(i)),
hit as (select rid, dw.n, i, item from dw join bw on dw.g = bw.g and dw.n = bw.n),
pos as (select rid, count(distinct p) n_hit from (select rid, unnest(range(i, i + n)) p from hit) group by rid),
its as (select rid, count(*) n_items, sha256(string_agg(item, ',' order by item)) h from (select distinct rid, item from hit) group by rid)
select d.doc_id, cast(len(w) as bigint) n_words, cast(coalesce(n_hit, 0) as bigint) n_hit, cast(coalesce(n_items, 0) as bigint) n_items,
  coalesce(h, sha256('')) items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) contaminated
from d left join pos using (rid) left join its using (rid)
"""


_ESCAPE = r"regexp_replace({x}, '([<\[])(\\*)(/?s>|/?INST\]|/?ROLE\]|SEP\])', '\1\\\2\3', 'g')"

OP8 = f"""
with c as (select conv_id, turn, coalesce(role, '') r, coalesce(text, '') t from conversations
  union all select -1, i, x, '</s>[INST] ok [/INST]' from (values (0, 'user'), (1, 'assistant')) v(i, x)),
e as (select *, lag(r) over w before, lead(r) over w after, length({_ESCAPE.format(x="t")}) n from c window w as (partition by conv_id order by turn, r, t)),
m as (select *, case when before = r then 7 when r = 'user' then 7 when r = 'assistant' then 4 else 14 + length({_ESCAPE.format(x="r")}) end
  + case when after = r then 0 when r = 'user' then 8 when r = 'assistant' then 5 else 8 end + n chars from e)
select conv_id, count(*) n_turns, sha256(string_agg(r || chr(10) || t || chr(10), '' order by turn, r, t)) turns_sha256,
  cast(coalesce(sum(length(t)) filter (r = 'assistant'), 0) as bigint) loss_chars,
  sha256(coalesce(string_agg(t, '' order by turn, r, t) filter (r = 'assistant'), '')) loss_sha256, cast(sum(chars) as bigint) formatted_chars
from m group by conv_id
"""

OP9 = f"""
with d as (select row_number() over () rid, doc_id, text from documents),
l as (select rid, doc_id, i - 1 i, line from (select rid, doc_id, unnest(string_split(text, chr(10))) line, generate_subscripts(string_split(text, chr(10)), 1) i from d)),
solid as (select *, row_number() over (partition by rid order by i) j from l where not regexp_matches(line, '^[ \\t\\r]*$')),
w as (select rid, doc_id, j, i a, i b, [line] g from solid where length(line) >= {LONG}
  union all select rid, doc_id, j, i a, lead(i, {RUN - 1}) over o b, array_agg(line) over (partition by rid order by j rows between current row and {RUN - 1} following) g from solid window o as (partition by rid order by j)),
whole as (select * from w where b is not null),
first as (select g, min((doc_id, j)) f from whole group by g),
gone as (select distinct rid, unnest(range(a, b + 1)) i from whole join first using (g) where (doc_id, j) > f),
kept as (select rid, string_agg(line, chr(10) order by i) t from l anti join gone using (rid, i) group by rid),
n as (select rid, count(*) n from l group by rid), x as (select rid, count(*) n from gone group by rid)
select d.doc_id, coalesce(n.n, 0) n_lines, coalesce(x.n, 0) n_deleted, sha256(coalesce(t, '')) kept_sha256
from d left join kept using (rid) left join n using (rid) left join x using (rid)
"""


def oracle_sql() -> dict[str, str]:
    return {"op3_substring_dedup": OP3, "op4_benchmark_decontamination": OP4, "op8_chat_formatting": OP8, "op9_line_dedup": OP9}
