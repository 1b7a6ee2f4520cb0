"""Each query in DuckDB SQL, written from the definitions, for results to be held against."""

from __future__ import annotations

from titleweave.config import DEFAULT
from titleweave.operators.misspell import KEYBOARD, neighbour_strings
from titleweave.plans.frozen import STUMPS

SEED, TOP, BETA = DEFAULT.seed, DEFAULT.top_n_predicting, DEFAULT.false_positive_penalty


def norm(x: str) -> str:
    return f"trim(regexp_replace(regexp_replace(replace(lower(strip_accents({x})), '-', ' '), '[^a-z0-9 ]', '', 'g'), ' +', ' ', 'g'))"


def cut(x: str, n: int) -> str:
    return f"case when length({x}) < 3 then lpad({x}, 3, '0') else trim(substr({x}, 1, {n})) end"


def roll(op: str, *keys: str) -> str:
    parts = " || '|' || ".join([f"'{SEED}|{op}'", *[f"cast({k} as varchar)" for k in keys]])
    return f"cast('0x' || substr(md5({parts}), 1, 7) as bigint)"


TITLES = f"titles as (select doc_id id, {cut('w', DEFAULT.max_characters)} s from (select doc_id, {norm('split_part(text, chr(10), 1)')} w from documents where text is not null))"
T = "t as (select id title_id, s from titles where id % 10 <> 0)"
Q = "q as (select id test_index, s from titles where id % 10 = 0)"
GRAMS = """qg as (select distinct test_index, substr(s, i, 3) g from q, unnest(range(1, length(s) - 1)) u(i)),
tg as (select distinct title_id, substr(s, i, 3) g from t, unnest(range(1, length(s) - 1)) u(i)),
n as (select count(*) n from t),
idf as (select g, count(*) df, cast(round(ln(max(n.n) * 1.0e0 / count(*)) * 1000000) as bigint) w from tg cross join n group by g)"""
SCORES = """mx as (select max(w) m from idf),
qs as (select test_index, cast(sum(coalesce(idf.w, mx.m)) as bigint) qsum from qg left join idf on qg.g = idf.g cross join mx group by test_index),
ts as (select title_id, cast(sum(w) as bigint) tsum from tg join idf on tg.g = idf.g group by title_id),
ov as (select test_index, title_id, cast(sum(w) as bigint) shared from qg join tg on qg.g = tg.g join idf on idf.g = qg.g group by test_index, title_id),
sc as (select ov.test_index, ov.title_id, round(cast(shared as double) / (qsum + tsum - shared), 6) score
  from ov join qs on ov.test_index = qs.test_index join ts on ov.title_id = ts.title_id where shared > 0),
rk as (select *, row_number() over (partition by test_index order by score desc, title_id desc) rn from sc)"""
WORDS = "tw as (select title_id, unnest(string_split(s, ' ')) word, generate_subscripts(string_split(s, ' '), 1) - 1 pos from t)"
WDF = "wdf as (select word, count(distinct title_id) df from tw group by word)"
BASE, PAIRED = f"with recursive {TITLES}, {T}, {Q}", f"{GRAMS}, {SCORES}, p3 as (select test_index, title_id, q.s a, t.s b from rk join q using (test_index) join t using (title_id) where rn <= {DEFAULT.top_n_training})"


#: Bits of a limb of a state, which has as many limbs as a title of full length needs.
LIMB, LIMBS = 100, 3


def lcs(pairs: str, out: str) -> str:
    """CTEs giving out(a, b, lcs) for pairs(a, b) distinct and not empty, bit by bit, in limbs with carries."""
    each = lambda form, sep=", ": sep.join(form.format(k=k, first=k * LIMB, last=k * LIMB + LIMB) for k in range(LIMBS))
    full = "((1::hugeint << least(greatest(length(b) - {first}, 0), 100)::hugeint) - 1)"
    total, carry = [], ""
    for k in range(LIMBS):
        total.append(f"(v{k} + (v{k} & coalesce(m{k}, 0::hugeint)){carry})")
        carry = f" + ({total[k]} >> {LIMB}::hugeint)"
    now = ", ".join(f"({total[k]} | (v{k} - (v{k} & coalesce(m{k}, 0::hugeint)))) & f{k}" for k in range(LIMBS))
    return f"""{out}_p as materialized (select row_number() over () id, a, b from (select distinct a, b from {pairs} where length(a) > 0 and length(b) > 0)),
{out}_k as materialized (select id, ch, {each("coalesce(bit_or(1::hugeint << ((j - 1) % 100)::hugeint) filter (j > {first} and j <= {last}), 0::hugeint) m{k}")} from (select id, j, substr(b, j, 1) ch from {out}_p, unnest(range(1, length(b) + 1)) u(j)) group by id, ch),
{out}_r as (select id, a, length(b) n, 0 i, {each(full + " v{k}")}, {each(full + " f{k}")} from {out}_p
  union all select r.id, a, n, i + 1, {now}, {each("f{k}")}
  from {out}_r r left join {out}_k mk on mk.id = r.id and mk.ch = substr(a, i + 1, 1) where i < length(a)),
{out} as (select p.a, p.b, n - {each("bit_count(v{k})", " - ")} lcs from {out}_r r join {out}_p p using (id) where i = length(r.a))"""


def ratio(a: str, b: str, common: str) -> str:
    return f"(cast(2 * {common} as double) / (length({a}) + length({b})) * 100)"


def bound(a: str, b: str) -> str:
    return f"(cast(length({a}) + length({b}) - abs(length({a}) - length({b})) as double) / (length({a}) + length({b})) * 100)"


def sorted_words(x: str) -> str:
    return f"array_to_string(list_sort(string_split({x}, ' ')), ' ')"


_NEAR = "map {" + ", ".join(f"'{a}': '{b}'" for a, b in neighbour_strings().items()) + "}"


def edit(op: str, x: str, key: str) -> str:
    """The expression of one edit of x."""
    ch = lambda i: f"substr({x}, {i}, 1)"
    before, after = f"substr({x}, 1, p - 1)", lambda i: f"substr({x}, {i})"

    def over(fits: str, made: str) -> str:
        places = f"list_filter(range(1, length({x}) + 1), lambda i: {fits})"
        return f"(case when len({places}) = 0 then {x} else list_transform([{places}[1 + {roll(op, key)} % len({places})]], lambda p: {made})[1] end)"

    letter = f"{ch('i')} between 'a' and 'z'"
    near = lambda: f"substr({_NEAR}[{ch('p')}], cast(1 + {roll(op + '_which', key)} % length({_NEAR}[{ch('p')}]) as bigint), 1)"
    if op == "remove_letter":
        return over(f"{ch('i')} <> ' '", f"{before} || {after('p + 1')}")
    if op == "add_letter":
        return over(letter, f"{before} || {near()} || {after('p')}")
    if op == "replace_letter":
        return over(letter, f"{before} || {near()} || {after('p + 1')}")
    if op == "add_space":
        return over(f"i > 1 and i < length({x}) and {ch('i')} <> ' ' and {ch('i - 1')} <> ' ' and {ch('i + 1')} <> ' '", f"{before} || ' ' || {after('p')}")
    if op == "remove_space":
        return over(f"{ch('i')} = ' '", f"{before} || {after('p + 1')}")
    parts = f"string_split({x}, ' ')"
    a, b = f"({roll('swap_word', key)} % len({parts}))", f"({roll('swap_word_with', key)} % len({parts}))"
    return f"array_to_string(list_transform({parts}, lambda w, i: case when i - 1 = {a} then {parts}[1 + {b}] when i - 1 = {b} then {parts}[1 + {a}] else w end), ' ')"


def generated(source: str, out: str) -> str:
    """CTEs giving out(title_id, s, made): source(title_id, s) misspelt."""

    def one(x: str, which: str) -> str:
        first, third = f"{roll('first', 'title_id')} % 3", f"{roll('third', 'title_id')} % 2"
        return f"""case {which} when 0 then case {first} when 0 then {edit('swap_word', x, 'title_id')} when 1 then {edit('add_letter', x, 'title_id')} else {edit('remove_letter', x, 'title_id')} end
when 1 then {edit('replace_letter', x, 'title_id')} else case {third} when 0 then {edit('add_space', x, 'title_id')} else {edit('remove_space', x, 'title_id')} end end"""

    first = f"({roll('order', 'title_id')} % 3)"
    second = f"(({roll('order', 'title_id')} % 3 + 1 + {roll('order_next', 'title_id')} % 2) % 3)"
    return f"""{out}_1 as (select title_id, s, {one('s', first)} x from {source}),
{out}_2 as (select title_id, s, case when {roll('edits', 'title_id')} % 2 = 0 then x else {one('x', second)} end y from {out}_1),
{out} as (select title_id, s, {cut('w', 255)} made from (select title_id, s, {norm('y')} w from {out}_2))"""


LONG = f"lng as (select title_id, s from t where length(s) >= {DEFAULT.least_generated_length})"
# the cascade's test rows: the test titles and misspellings of all long reference titles
CASCADE_Q = f"{LONG}, {generated('lng', 'gen')}, q as (select id test_index, s from titles where id % 10 = 0 union all select 1000000000 + title_id, made from gen)"
EXACT = "ex as (select test_index, m title_id from q join (select s, max(title_id) m from t group by s) using (s))"
NEAR = f"""cand as (select test_index, title_id, q.s a, t.s b from rk join q using (test_index) join t using (title_id) where rn <= {TOP} and test_index not in (select test_index from ex) and {bound('q.s', 't.s')} >= {DEFAULT.ratio_threshold}),
{lcs('cand', 'l1')}, plain as (select test_index, title_id, a, b, cast(round_even({ratio('cand.a', 'cand.b', 'lcs')}, 0) as integer) r from cand join l1 using (a, b)),
low as (select test_index, title_id, {sorted_words('a')} a, {sorted_words('b')} b from plain where r <= {DEFAULT.ratio_threshold}),
{lcs('low', 'l2')}, rt as (select test_index, title_id, r from plain where r > {DEFAULT.ratio_threshold} union all
  select test_index, title_id, cast(round_even({ratio('low.a', 'low.b', 'lcs')}, 0) as integer) from low join l2 using (a, b)),
good as (select *, rank() over (partition by test_index order by r desc) k from rt where r > {DEFAULT.ratio_threshold}),
nr as (select test_index, max(title_id) title_id, max(r) ratio from good where k = 1 group by test_index having count(*) = 1)"""
FINAL = f"{BASE.replace(', ' + Q, '')}, {CASCADE_Q}, {GRAMS}, {SCORES}, {EXACT}, {NEAR}, fin as (select coalesce(ex.title_id, nr.title_id, -1) title_id, test_index from q left join ex using (test_index) left join nr using (test_index))"

# training rows: misspellings of all long reference titles, and test titles that no reference title equals
TRAIN = f"""{LONG}, {generated('lng', 'gen')},
train as (select title_id train_index, made s, title_id true_id from gen union all
  select 1000000000 + id, s, -1 from titles where id % 10 = 0 and s not in (select s from t)),
q as (select train_index test_index, s, true_id from train)"""
PAIRS = f"""nb as (select *, row_number() over (partition by test_index order by {roll('neighbour', 'test_index', 'title_id')}, title_id) place from rk where rn <= {TOP}),
ten as (select test_index, true_id, title_id, place, bool_or(title_id = true_id) over (partition by test_index) has from nb join q using (test_index) where place <= {DEFAULT.top_n_training}),
near as (select test_index, true_id, title_id from ten where not (true_id <> -1 and not has and place = {DEFAULT.top_n_training})
  union all select test_index, true_id, true_id from q where true_id <> -1 and test_index not in (select test_index from ten where has)),
pairs as (select case when near.true_id = -1 then 2 else 3 end kind, q.s title, t.s truth_title, near.title_id, cast(near.true_id = near.title_id as integer) target
  from near join q using (test_index) join t on t.title_id = near.title_id
  union all select 1, made, s, title_id, 1 from gen)"""
TRAINING = f"{BASE.replace(', ' + Q, '')}, {TRAIN}, {GRAMS}, {SCORES}, {PAIRS}"
EVALUATED = f"""er as (select *, row_number() over (partition by kind order by {roll('evaluation', 'kind', 'title', 'truth_title', 'title_id')}, title, truth_title, title_id, target) k, count(*) over () n from pairs),
ev as (select kind, title, truth_title, title_id, target, k <= case kind when 1 then floor(n * {DEFAULT.evaluation_generated}) when 2 then floor(n * {DEFAULT.evaluation_negative}) else floor(n * {DEFAULT.evaluation_positive}) end is_eval from er)"""
SCORED = "sco as (select (o_orderkey % 97) / 97.0::double p, cast(o_orderstatus = 'F' as integer) y from orders)"

ALPHABET = "- abcdefghijklmnopqrstuvwxyz0123456789"


def sql() -> dict[str, str]:
    b, near3 = BASE, f"{BASE}, {PAIRED}"
    split = "string_split(s, ' ')"
    out = {
        "normalize_titles": f"with {TITLES} select id doc_id, s transformed_title from titles",
        "normalize_pages": f"with x as (select page_id, {norm('title')} w from (select page_id, regexp_extract(html, '<title>([^<\\n]*)</title>', 1) title from pages)) select page_id, {cut('w', 255)} transformed_title from x",
        "encode_titles": f"with {TITLES} select id doc_id, i pos, cast(instr('{ALPHABET}', substr(s, i, 1)) - 1 as integer) code from titles, unnest(range(1, length(s) + 1)) u(i)",
        "title_words": f"with {TITLES} select id doc_id, cast(len({split}) as integer) number_of_words, cast(i as integer) pos, {split}[i + 1] word from titles, unnest(range(0, len({split}))) u(i)",
        "title_ngrams": f"with {TITLES} select distinct id doc_id, substr(s, i, 3) g from titles, unnest(range(1, length(s) - 1)) u(i)",
        "word_document_frequency": f"with {TITLES}, {T}, {WORDS}, {WDF} select word, df from wdf",
        "word_idf": f"with {TITLES}, {T}, {WORDS}, {WDF} select word, round(ln((select count(*) from t) * 1.0e0 / df), 6) idf from wdf",
        "ngram_document_frequency": f"{b}, {GRAMS} select g, df from idf",
        "ngram_idf": f"{b}, {GRAMS} select g, w from idf",
        "ngram_vocabulary_union": f"{b}, {GRAMS} select g from qg union select g from tg",
        "truth_idf_sums": f"{b}, {GRAMS}, {SCORES} select title_id, tsum from ts",
        "query_idf_sums": f"{b}, {GRAMS}, {SCORES} select test_index, qsum from qs",
        "jaccard_scores": f"{b}, {GRAMS}, {SCORES} select test_index, title_id, score from sc",
        "closest_matches_topk": f"{b}, {GRAMS}, {SCORES} select test_index, title_id, score, rn from rk where rn <= {TOP}",
        "closest_matches_positional": f"{b}, {GRAMS}, {SCORES}, kt as (select test_index, min(score) v from rk where rn <= 10 group by 1), po as (select sc.*, row_number() over (partition by sc.test_index order by title_id desc) rn from sc join kt on kt.test_index = sc.test_index and score >= v - 0.000001) select test_index, title_id, score, rn from po where rn <= 10",
        "exact_matches": f"{b}, {EXACT} select test_index, title_id from ex",
        "exact_matches_parts": f"with x as (select p_partkey id, {norm('p_name')} s from part), m as (select s, max(id) title_id from x where id % 10 <> 0 group by s) select id test_index, title_id from x join m using (s) where id % 10 = 0",
        "remaining_after_exact": f"{b}, {EXACT} select test_index, s transformed_title from q where test_index not in (select test_index from ex)",
        "not_found_anti": f"{b}, {EXACT} select test_index from q except select test_index from ex",
        "length_bound": f"{near3} select test_index, title_id, round({bound('a', 'b')}, 6) bound from p3",
        "indel_ratio": f"{near3}, {lcs('p3', 'l')} select test_index, title_id, cast(round_even({ratio('p3.a', 'p3.b', 'lcs')}, 0) as integer) ratio, cast(floor({ratio('p3.a', 'p3.b', 'lcs')}) as integer) truncated from p3 join l using (a, b)",
        "token_sort_ratio": f"{near3}, so as (select test_index, title_id, {sorted_words('a')} a, {sorted_words('b')} b from p3), {lcs('so', 'l')} select test_index, title_id, cast(round_even({ratio('so.a', 'so.b', 'lcs')}, 0) as integer) ratio from so join l using (a, b)",
        "near_exact_matches": f"{FINAL} select test_index, title_id, ratio from nr",
        "unique_argmax": "select o_custkey, o_orderkey, total from (select o_custkey, o_orderkey, round(o_totalprice / 50000) total, rank() over (partition by o_custkey order by round(o_totalprice / 50000) desc) k, count(*) over (partition by o_custkey, round(o_totalprice / 50000)) n from orders) where k = 1 and n = 1",
        "pair_features_basic": f"{near3}, {lcs('p3', 'l')} select test_index, title_id, cast(length(p3.a) as integer) title_chars, cast(length(p3.b) as integer) truth_chars, cast(length(p3.a) - length(replace(p3.a, ' ', '')) + 1 as integer) title_words, cast(length(p3.b) - length(replace(p3.b, ' ', '')) + 1 as integer) truth_words, cast(floor({ratio('p3.a', 'p3.b', 'lcs')}) as integer) ratio from p3 join l using (a, b)",
        "truth_word_counts": f"with {TITLES}, {T}, {WORDS}, {WDF} select title_id, cast(pos + 1 as integer) pos, df from tw join wdf using (word) where pos < 15",
        "pair_features_words": f"{near3}, {WORDS}, {WDF}, f as (select test_index, p3.title_id, cast(pos + 1 as integer) pos, cast(length(word) as integer) length, ln((select count(*) from t) * 1.0e0 / df) idf, len(string_split(b, ' ')) n from p3 join tw using (title_id) join wdf using (word) where pos < 15) select test_index, title_id, pos, length, round(idf, 6) idf, round(1 + (max(idf) over (partition by test_index, title_id) - idf) / n, 6) rank from f",
    }
    best = f"""{near3}, {WORDS}, wi as (select test_index, title_id, pos, word b, i, substr(replace(p3.a, ' ', ''), i, length(word)) a, p3.b whole from p3 join tw using (title_id), unnest(range(1, greatest(length(replace(p3.a, ' ', '')), 0) + 1)) u(i) where pos < 15),
{lcs('wi', 'l')}, br as (select test_index, title_id, whole, pos, wi.a part, cast(floor({ratio('wi.a', 'wi.b', 'lcs')}) as integer) r, i from wi join l using (a, b)),
be as (select test_index, title_id, whole, pos, case when r > 0 then part else ' ' end part, r from (select *, row_number() over (partition by test_index, title_id, pos order by r desc, i) k from br) where k = 1)"""
    out["word_best_ratio"] = f"{best} select test_index, title_id, cast(pos + 1 as integer) pos, r best from be"
    out["reconstructed_ratio"] = f"{best}, re as (select test_index, title_id, whole b, string_agg(part, ' ' order by pos) a from be group by 1, 2, 3), {lcs('re', 'l3')} select test_index, title_id, re.a rebuilt, cast(floor({ratio('re.a', 're.b', 'lcs')}) as integer) rebuilt_ratio from re join l3 using (a, b)"
    keys = ", ".join(f"('{c}', {x}, {y})" for c, (x, y) in KEYBOARD.items())
    out["keyboard_neighbours"] = f"with k(letter, x, y) as (values {keys}) select a.letter, b.letter neighbour from k a join k b on a.letter <> b.letter and sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) <= 1"
    for op in ("remove_letter", "add_letter", "replace_letter", "add_space", "remove_space", "swap_word"):
        out[f"misspell_{op}"] = f"with {TITLES}, {T} select title_id, {edit(op, 's', 'title_id')} made from t"
    out |= {
        "generated_pairs": f"with {TITLES}, {T}, {LONG}, {generated('lng', 'gen')} select title_id, made title, s truth_title from gen",
        "training_pairs": f"{TRAINING} select kind, title, truth_title, title_id, target from pairs",
        "evaluation_split": f"{TRAINING}, {EVALUATED} select kind, title, truth_title, title_id, target, is_eval from ev",
        "weighted_log_loss": f"with s as (select o_orderkey, (o_orderkey % 97) / 97.0::double p, cast(o_orderstatus = 'F' as integer) y from orders) select o_orderkey, round(p * ({BETA} + y - {BETA} * y) - y, 9) gradient, round(p * (1 - p) * ({BETA} + y - {BETA} * y), 9) hessian from s",
        "custom_error": f"with {SCORED} select sum(case when p <= 0.9 and y = 1 then 1.0::double when p > 0.9 and y = 0 then {BETA}::double else 0.0::double end) custom_error from sco",
        "class_ratio": f"with {SCORED} select count(*) filter (y = 0) / count(*) filter (y = 1)::double class_ratio from sco",
        "error_matrix": f"with {SCORED} select count(*) filter (p > 0.9 and y = 1) true_positives, count(*) filter (p <= 0.9 and y = 0) true_negatives, count(*) filter (p > 0.9 and y = 0) false_positives, count(*) filter (p <= 0.9 and y = 1) false_negatives from sco",
        "final_output": f"{FINAL} select title_id, test_index from fin",
        "accuracy_report": f"{FINAL}, c as (select case when test_index >= 1000000000 then test_index - 1000000000 else -1 end a, title_id p from fin) select count(*) filter (p <> -1 and p = a) correctly_matched, count(*) filter (p <> -1 and p <> a) incorrectly_matched, count(*) filter (p = -1 and a = -1) correctly_not_found, count(*) filter (p = -1 and a <> -1) incorrectly_not_found, count(*) filter (p = -1 and a <> -1) + {BETA}::double * count(*) filter (p <> -1 and p <> a) custom_error from c",
        "single_title_search": f"{BASE.replace(', ' + Q, '')}, q as (select 0 test_index, 'the and attion to thenedble the anea erinr thanea and more' s), {GRAMS}, {SCORES} select title_id, s \"match\", score prediction from rk join t using (title_id) where rn = 1",
        "delimited_round_trip": f"{b} select id test_index, title, s transformed_title from titles join (select doc_id id, split_part(text, chr(10), 1) title from documents) using (id) where id % 10 = 0",
    }
    out["delimited_gzip_round_trip"] = out["delimited_round_trip"]
    stumps = " + ".join(f"case when {f} >= {least} then {up}::double else {down}::double end" for f, least, up, down in STUMPS)
    kinds = {"best": "best", "length": "len", "idf": "idf", "rank": "rnk"}
    spread = lambda some: ", ".join(f"coalesce(max({kinds[k]}) filter (pos = {i - 1}), -1)::double {k}_{i}" for k in some for i in range(1, 16))
    names_of = lambda some: ", ".join(f"{k}_{i}" for k in some for i in range(1, 16))
    plain = f"length(fp.a)::double title_chars, length(fp.b)::double truth_chars, len(string_split(fp.a, ' '))::double title_words, len(string_split(fp.b, ' '))::double truth_words, floor({ratio('fp.a', 'fp.b', 'fl1.lcs')}) ratio"
    # features of pairs fp(test_index, title_id, a, b): those of words and lengths, and with the stretches of words all 66
    lean = f"""{WORDS}, {WDF}, {lcs("fp", "fl1")},
fw as (select test_index, title_id, pos, length(word) len, ln((select count(*) from t) * 1.0e0 / df) idf, len(string_split(fp.b, ' ')) n from fp join tw using (title_id) join wdf using (word) where pos < 15),
fx as (select *, 1 + (max(idf) over (partition by test_index, title_id) - idf) / n rnk from fw),
fr as (select test_index, title_id, {spread(("length", "idf", "rank"))} from fx group by all),
feat as (select fp.test_index, fp.title_id, {plain}, {names_of(("length", "idf", "rank"))} from fp join fl1 on fl1.a = fp.a and fl1.b = fp.b join fr on fr.test_index = fp.test_index and fr.title_id = fp.title_id)"""
    table = f"""{WORDS}, {WDF}, {lcs("fp", "fl1")}, wi as (select distinct a whole_a, word b, i, substr(replace(a, ' ', ''), i, length(word)) a from fp join tw using (title_id), unnest(range(1, length(replace(a, ' ', '')) + 1)) u(i) where pos < 15),
{lcs("wi", "fl2")}, br as (select whole_a, wi.b word, wi.a part, cast(floor({ratio('wi.a', 'wi.b', 'lcs')}) as integer) r, i from wi join fl2 using (a, b)),
be as (select whole_a, word, case when r > 0 then part else ' ' end part, r from (select *, row_number() over (partition by whole_a, word order by r desc, i) k from br) where k = 1),
fw as (select test_index, title_id, fp.a, fp.b, pos, length(word) len, ln((select count(*) from t) * 1.0e0 / df) idf, coalesce(be.r, 0) best, coalesce(be.part, ' ') part, len(string_split(fp.b, ' ')) n from fp join tw using (title_id) join wdf using (word) left join be on be.whole_a = fp.a and be.word = tw.word where pos < 15),
fx as (select *, 1 + (max(idf) over (partition by test_index, title_id) - idf) / n rnk from fw),
fr as (select test_index, title_id, b, string_agg(part, ' ' order by pos) a, {spread(kinds)} from fx group by all),
{lcs("fr", "fl3")}, feat as (select fp.test_index, fp.title_id, {plain}, floor({ratio('fr.a', 'fr.b', 'fl3.lcs')}) rebuilt_ratio, {names_of(kinds)}
  from fp join fl1 on fl1.a = fp.a and fl1.b = fp.b join fr on fr.test_index = fp.test_index and fr.title_id = fp.title_id join fl3 on fl3.a = fr.a and fl3.b = fr.b)"""
    wide_names = names_of(kinds)
    scored = f"mp as (select test_index, title_id, 1 / (1 + exp(-({stumps}))) p from feat)"
    rest = f"fp as materialized (select test_index, title_id, q.s a, t.s b from rk join q using (test_index) join t using (title_id) where rn <= {TOP} and test_index not in (select test_index from ex) and test_index not in (select test_index from nr))"
    model = f"mm as (select test_index, max(title_id) title_id from (select *, rank() over (partition by test_index order by p desc) k from mp where p > 0.9) where k = 1 group by test_index having count(*) = 1)"
    cascade = FINAL[: FINAL.index(", fin as (")]
    rounded = ", ".join(f"round({c}, 6) {c}" for c in [*("title_chars truth_chars title_words truth_words ratio rebuilt_ratio".split()), *wide_names.split(", ")])
    out["pair_feature_table"] = f"{near3}, fp as materialized (select * from p3), {table} select test_index, title_id, {rounded} from feat"
    out["frozen_model_predictions"] = f"{cascade}, {rest}, {lean}, {scored}, {model} select coalesce(ex.title_id, nr.title_id, mm.title_id, -1) title_id, test_index from q left join ex using (test_index) left join nr using (test_index) left join mm using (test_index)"
    out["frozen_model_evaluation"] = f"""{TRAINING}, {EVALUATED}, fp as materialized (select row_number() over () test_index, title a, truth_title b, title_id, target, is_eval from ev), {lean}, {scored},
sc2 as (select is_eval, p, target y from fp join mp using (test_index, title_id)),
au as (select is_eval, sum(up * (below + down / 2)) / (sum(up)::double * sum(down)) area from (select *, coalesce(sum(down) over (partition by is_eval order by p rows between unbounded preceding and 1 preceding), 0) below from (select is_eval, p, count(*) filter (y = 1) up, count(*) filter (y = 0) down from sc2 group by is_eval, p)) group by is_eval)
select is_eval, count(*) filter (p > 0.9 and y = 1) true_positives, count(*) filter (p <= 0.9 and y = 0) true_negatives, count(*) filter (p > 0.9 and y = 0) false_positives, count(*) filter (p <= 0.9 and y = 1) false_negatives, count(*) filter (p <= 0.9 and y = 1) + {BETA}::double * count(*) filter (p > 0.9 and y = 0) custom_error, any_value(au.area) area from sc2 join au using (is_eval) group by is_eval"""
    out["area_under_curve"] = f"with {SCORED} select round((select sum((a.p > b.p)::int + 0.5 * (a.p = b.p)::int) from (select p, count(*) c from sco where y = 1 group by p) g(p, c), lateral (select g.p p from range(g.c)) a, (select p from sco where y = 0) b) / (count(*) filter (y = 1) * count(*) filter (y = 0)::double), 9) area from sco"
    line = "split_part(text, chr(10), 1)"
    title = f"{cut('w', DEFAULT.max_characters)}"
    load = f"x as (select *, {norm('line')} w from (select doc_id, n_chars % 7 owner, {line} line from documents)), z as (select *, {title} s from x)"
    derived = "line title, s transformed_title, cast(len(string_split(s, ' ')) as integer) number_of_words"
    out["load_truth"] = f"with {load} select doc_id title_id, {derived} from z"
    out["load_train"] = f"with {load} select doc_id train_index, owner title_id, {derived} from z"
    out["load_test"] = f"with {load} select doc_id test_index, {derived} from z"
    out["load_actuals"] = f"with {load} select doc_id test_index, owner title_id from z"
    return out
