"""DuckDB SQL for the registered queries, written apart from the Spark code.

The exact stage of the queries about it alone is a recursion of any depth. In the queries that go on
from it, greedy stages are unrolled to three rounds, which is as deep as chains get in the projected
rows; they are not a general form of those stages.
"""

from __future__ import annotations

from .functions.text import BOILERPLATE
from .plans.projection import SQL as BASE

STOP = ", ".join(f"'{w}'" for w in BOILERPLATE)
TOKENS = f"list_filter(list_distinct(regexp_extract_all(lower(description), '[a-z0-9]+')), lambda x: length(x) > 2 AND x NOT IN ({STOP}))"
FORMS = "CASE WHEN coalesce(reference, '') = '' THEN [] WHEN regexp_full_match(reference, '[0-9]+') THEN list_distinct([reference, coalesce(nullif(ltrim(reference, '0'), ''), '0')]) ELSE [lower(reference)] END"


def same(t: str, u: str) -> str:
    return f"({t} = {u} OR (least(length({t}), length({u})) >= 4 AND (starts_with({t}, {u}) OR starts_with({u}, {t}))))"


def hits(a: str, b: str) -> str:
    return f"len(list_filter({a}, lambda t: len(list_filter({b}, lambda u: {same('t', 'u')})) > 0))"


DICE = f"CASE WHEN len(b.tokens) = 0 OR len(l.tokens) = 0 THEN 0.0 ELSE ({hits('b.tokens', 'l.tokens')} + {hits('l.tokens', 'b.tokens')})::DOUBLE / (len(b.tokens) + len(l.tokens)) END"
SIMILARITY = f"CASE WHEN coalesce(b.reference, '') <> '' AND coalesce(l.reference, '') <> '' AND lower(b.reference) = lower(l.reference) THEN 1.0 ELSE least({DICE}, 0.99) END"
CORROBORATION = f"CASE WHEN list_has_any(b.forms, l.forms) THEN 'reference' WHEN {hits('b.tokens', 'l.tokens')} > 0 THEN 'description' ELSE 'amount_and_date_only' END"
FEE = "abs(b.amount - l.amount) <= greatest(500, greatest(abs(b.amount), abs(l.amount)) * 0.02)"

PREPARED = f"""{BASE},
pb AS MATERIALIZED (SELECT *, {TOKENS} AS tokens, {FORMS} AS forms FROM bank),
pl AS MATERIALIZED (SELECT *, {TOKENS} AS tokens, {FORMS} AS forms FROM ledger)"""

CANDIDATES = f"""{PREPARED},
c0 AS MATERIALIZED (SELECT b.id AS bank_id, l.id AS ledger_id, (b.date, b.ord) AS turn, b.date = l.date AS same_date, {SIMILARITY} AS similarity, {CORROBORATION} AS corroboration
    FROM pb b JOIN pl l ON b.amount = l.amount AND abs(date_diff('day', b.date, l.date)) <= 3)"""


def exact_round(i: int) -> str:
    return f""",
f{i} AS (SELECT ledger_id, min(turn) AS first FROM c{i} GROUP BY ledger_id),
r{i} AS MATERIALIZED (SELECT bank_id FROM c{i} JOIN f{i} USING (ledger_id) GROUP BY bank_id HAVING bool_and(turn = first)),
t{i} AS MATERIALIZED (SELECT bank_id, x.ledger_id AS ledger_id, 'exact_amount_' || CASE WHEN x.same_date THEN 'same_date' ELSE 'near_date' END || CASE WHEN n > 1 THEN '_fuzzy_desc' ELSE '' END AS rule, x.similarity AS similarity, x.corroboration AS corroboration
    FROM (SELECT bank_id, count(*) AS n, list_sort(list(similarity), 'DESC') AS top, max({{'similarity': similarity, 'ledger_id': ledger_id, 'same_date': same_date, 'corroboration': corroboration}}) AS x FROM c{i} SEMI JOIN r{i} USING (bank_id) GROUP BY bank_id)
    WHERE n = 1 OR (x.similarity >= 0.85 AND top[1] > top[2])),
c{i + 1} AS MATERIALIZED (SELECT * FROM c{i} ANTI JOIN r{i} USING (bank_id) ANTI JOIN t{i} USING (ledger_id))"""


EXACT = f"""{CANDIDATES}{exact_round(0)}{exact_round(1)}{exact_round(2)},
exact AS MATERIALIZED (SELECT * FROM t0 UNION ALL SELECT * FROM t1 UNION ALL SELECT * FROM t2),
lb AS MATERIALIZED (SELECT pb.* FROM pb ANTI JOIN (SELECT bank_id AS id FROM exact) USING (id)),
ll AS MATERIALIZED (SELECT pl.* FROM pl ANTI JOIN (SELECT ledger_id AS id FROM exact) USING (id))"""

# Every amount's bank rows choose one after another, in islands of dates without a gap wider than the window
# that have several rows of a side; what is taken goes along with the walk. Any depth of chains.
WALKED = f"""{PREPARED},
days AS (SELECT amount, date, bool_or(is_bank) AS b, bool_or(NOT is_bank) AS l FROM (SELECT amount, date, TRUE AS is_bank FROM pb UNION ALL SELECT amount, date, FALSE FROM pl) GROUP BY ALL),
cuts AS (SELECT amount, date, CASE WHEN date_diff('day', lag(date) OVER (PARTITION BY amount ORDER BY date), date) > 3 THEN 1 ELSE 0 END AS cut FROM days),
isles AS MATERIALIZED (SELECT amount, date, sum(cut) OVER (PARTITION BY amount ORDER BY date)::BIGINT AS isle FROM cuts),
seen AS MATERIALIZED (SELECT b.id AS bank_id, list({{'similarity': {SIMILARITY}, 'ledger_id': l.id, 'same': b.date = l.date, 'corroboration': {CORROBORATION}}} ORDER BY {SIMILARITY} DESC, l.id) AS found
    FROM pb b JOIN pl l ON b.amount = l.amount AND abs(date_diff('day', b.date, l.date)) <= 3 GROUP BY b.id),
turns AS MATERIALIZED (SELECT b.amount, i.isle, b.id AS bank_id, row_number() OVER (PARTITION BY b.amount, i.isle ORDER BY b.date, b.ord, b.id) AS turn, n.found FROM pb b JOIN isles i ON i.amount = b.amount AND i.date = b.date JOIN seen n ON n.bank_id = b.id),
walk AS (
    SELECT amount, isle, 0::BIGINT AS turn, []::VARCHAR[] AS taken, NULL::VARCHAR AS bank_id, 0::BIGINT AS n, found[1] AS pick FROM turns WHERE turn = 1
    UNION ALL
    SELECT amount, isle, turn, CASE WHEN pick IS NULL THEN taken ELSE list_append(taken, pick.ledger_id) END, bank_id, n, pick FROM (
        SELECT amount, isle, turn, taken, bank_id, len(free)::BIGINT AS n, CASE WHEN len(free) = 1 OR len(free) > 1 AND free[1].similarity >= 0.85 AND free[1].similarity > free[2].similarity THEN free[1] END AS pick
        FROM (SELECT t.amount, t.isle, t.turn, w.taken, t.bank_id, list_filter(t.found, lambda x: NOT list_contains(w.taken, x.ledger_id)) AS free FROM walk w JOIN turns t ON t.amount = w.amount AND t.isle = w.isle AND t.turn = w.turn + 1))),
exact AS MATERIALIZED (SELECT bank_id, pick.ledger_id AS ledger_id, 'exact_amount_' || CASE WHEN pick.same THEN 'same_date' ELSE 'near_date' END || CASE WHEN n > 1 THEN '_fuzzy_desc' ELSE '' END AS rule, pick.similarity AS similarity, pick.corroboration AS corroboration FROM walk WHERE bank_id IS NOT NULL AND pick IS NOT NULL),
lb AS MATERIALIZED (SELECT pb.* FROM pb ANTI JOIN (SELECT bank_id AS id FROM exact) USING (id)),
ll AS MATERIALIZED (SELECT pl.* FROM pl ANTI JOIN (SELECT ledger_id AS id FROM exact) USING (id))"""

#: The same with the ledger's amounts under the other sign.
TURNED = WALKED.replace("pl AS MATERIALIZED (SELECT *,", "pl AS MATERIALIZED (SELECT * REPLACE (-amount AS amount),", 1)

EDGES = f"""{EXACT},
e0 AS MATERIALIZED (SELECT * FROM (SELECT b.id AS bank_id, l.id AS ledger_id, {SIMILARITY} AS similarity, {CORROBORATION} AS corroboration, abs(b.amount - l.amount) AS amount_gap, abs(date_diff('day', b.date, l.date)) AS date_gap, b.ord AS bank_ord, l.ord AS ledger_ord
    FROM lb b JOIN ll l ON (b.amount > 0) = (l.amount > 0) AND abs(date_diff('day', b.date, l.date)) <= 7 AND {FEE}) WHERE similarity >= 0.35)"""


def assign_round(i: int, order: str, e: str = "e") -> str:
    return f""",
k{e}{i} AS MATERIALIZED (SELECT * EXCLUDE (rb, rl) FROM (SELECT *, row_number() OVER (PARTITION BY bank_id ORDER BY {order}) AS rb, row_number() OVER (PARTITION BY ledger_id ORDER BY {order}) AS rl FROM {e}{i}) WHERE rb = 1 AND rl = 1),
{e}{i + 1} AS MATERIALIZED (SELECT * FROM {e}{i} ANTI JOIN k{e}{i} USING (bank_id) ANTI JOIN (SELECT ledger_id FROM k{e}{i}) USING (ledger_id))"""


NEAR_ORDER = "similarity DESC, amount_gap, date_gap, bank_ord, ledger_ord"
PAIRS = f"""{EDGES}{"".join(assign_round(i, NEAR_ORDER) for i in range(3))},
near AS MATERIALIZED (SELECT bank_id, ledger_id, 'near_amount_matching_description' AS rule, similarity, CASE WHEN corroboration = 'reference' THEN 'reference' ELSE 'description' END AS corroboration FROM (SELECT * FROM ke0 UNION ALL SELECT * FROM ke1 UNION ALL SELECT * FROM ke2)),
pairs AS MATERIALIZED (SELECT * FROM exact UNION ALL SELECT * FROM near),
paired AS MATERIALIZED (SELECT p.*, b.date AS bank_date, l.date AS ledger_date, (b.amount - l.amount)::DECIMAL(18,2) AS amount_gap, abs(date_diff('day', b.date, l.date))::BIGINT AS date_gap FROM pairs p JOIN bank b ON b.id = p.bank_id JOIN ledger l ON l.id = p.ledger_id),
ub AS MATERIALIZED (SELECT * FROM bank ANTI JOIN (SELECT bank_id AS id FROM pairs) USING (id)),
ul AS MATERIALIZED (SELECT * FROM ledger ANTI JOIN (SELECT ledger_id AS id FROM pairs) USING (id)),
sums AS MATERIALIZED (SELECT *, bank_total - ledger_total AS difference, pair_differences + bank_only - ledger_only AS explained FROM
    (SELECT count(*) AS bank_n, coalesce(sum(amount), 0) AS bank_total FROM bank), (SELECT count(*) AS ledger_n, coalesce(sum(amount), 0) AS ledger_total FROM ledger),
    (SELECT count(*) AS matched_n, count_if(amount_gap <> 0) AS amounts_n, count_if(date_gap <> 0) AS dates_n, count_if(corroboration = 'amount_and_date_only') AS weak_n, coalesce(sum(amount_gap), 0) AS pair_differences FROM paired),
    (SELECT count(*) AS bank_only_n, coalesce(sum(amount), 0) AS bank_only FROM ub), (SELECT count(*) AS ledger_only_n, coalesce(sum(amount), 0) AS ledger_only FROM ul))"""

ISSUE = "nullif(concat_ws('; ', CASE WHEN amount_gap <> 0 THEN 'amount differs by ' || abs(amount_gap)::DECIMAL(18,2) END, CASE WHEN date_gap <> 0 THEN 'booked ' || date_gap || ' day(s) apart' END, CASE WHEN corroboration = 'amount_and_date_only' THEN 'no shared reference or payee — matched on figures alone' END), '')"
ALL = f"{BASE}, txns AS MATERIALIZED (SELECT * FROM bank UNION ALL SELECT * FROM ledger)"


def clusters(base: str) -> str:
    return f"""{base}, txns AS (SELECT * FROM bank UNION ALL SELECT * FROM ledger),
chained AS (SELECT *, sum(CASE WHEN gap > 1 THEN 1 ELSE 0 END) OVER (PARTITION BY source, amount, what ORDER BY date, ord) AS chain FROM
    (SELECT *, lower(description) AS what, date_diff('day', lag(date) OVER (PARTITION BY source, amount, lower(description) ORDER BY date, ord), date) AS gap FROM txns)),
clusters AS MATERIALIZED (SELECT source, amount, what, list(id ORDER BY date, ord) AS members, list(date ORDER BY date, ord) AS dates FROM chained GROUP BY source, amount, what, chain HAVING count(*) > 1)"""


def reasons(side: str, left: str, others: str, where: str, default: str) -> str:
    bank_said = "CASE " + " ".join(f"WHEN contains(lower(u.description), '{f}') THEN '{label} — {where}'" for f, label in (("chrg", "bank charge"), ("charge", "bank charge"), ("int.pd", "interest paid by bank"), ("int pd", "interest paid by bank"), ("interest", "interest"), ("gst", "tax debited by bank"), ("tds", "tax deducted at source"))) + " END"
    return f"""SELECT u.id, '{side}' AS source, coalesce({bank_said},
    CASE WHEN s.n > 1 THEN 'ambiguous — ' || s.n || ' rows on the other side share this amount; none chosen rather than guessing'
         WHEN s.n = 1 THEN 'same amount exists on the other side but is dated ' || s.only_date || ' (' || abs(date_diff('day', u.date, s.only_date)) || ' days away, outside the 3-day window)'
         WHEN w.near IS NOT NULL THEN 'no exact amount; closest is ' || w.near.amount || ' on ' || w.near.date || ' (' || substr(w.near.description, 1, 40) || ')'
         ELSE {default} END) AS reason
    FROM {left} u LEFT JOIN (SELECT amount, count(*) AS n, min(date) AS only_date FROM {others} GROUP BY amount) s ON s.amount = u.amount
    LEFT JOIN (SELECT b.id, arg_min({{'amount': l.amount, 'date': l.date, 'description': l.description}}, (abs(date_diff('day', b.date, l.date)), l.ord)) AS near FROM {left} b JOIN {others} l ON {FEE} GROUP BY b.id) w ON w.id = u.id"""


STATEMENT = f"""{BASE}, st0 AS (SELECT *, row_number() OVER w AS ord, (sum(a) OVER (PARTITION BY customer ORDER BY d, k ROWS UNBOUNDED PRECEDING))::DECIMAL(18,2) AS balance,
    CAST(CASE WHEN k % 97 = 0 THEN a + 7 WHEN k % 89 = 0 THEN 0 WHEN k % 83 = 0 THEN -a ELSE a END AS DECIMAL(18,2)) AS amount FROM payments WINDOW w AS (PARTITION BY customer ORDER BY d, k)),
statement AS MATERIALIZED (SELECT *, (balance - coalesce(lag(balance) OVER (PARTITION BY customer ORDER BY ord), 0))::DECIMAL(18,2) AS moved FROM st0)"""

SUMMARY = (
    ("Bank transactions", "bank_n", "bank_total"), ("Ledger transactions", "ledger_n", "ledger_total"), ("Difference to explain", "NULL", "difference"), ("Matched", "matched_n", "NULL"),
    ("  amounts disagree", "amounts_n", "NULL"), ("  booked on different dates", "dates_n", "NULL"), ("  matched on figures alone", "weak_n", "NULL"), ("Bank-only items", "bank_only_n", "bank_only"),
    ("Ledger-only items", "ledger_only_n", "ledger_only"), ("Explained by matched-pair differences", "NULL", "pair_differences"), ("Explained by bank-only items", "NULL", "bank_only"),
    ("Less ledger-only items", "NULL", "-ledger_only"), ("Total explained", "NULL", "explained"), ("UNEXPLAINED", "NULL", "difference - explained"),
)
PAIR_K = f"WITH {PREPARED} SELECT b.id AS bank_id, l.id AS ledger_id, ~ FROM pb b JOIN pl l ON b.ord // 4 = l.ord // 4"
N = "'N' || lpad(k::VARCHAR, 9, '0')"
# bank, kind, whether it has a reference, whether it names a counterparty, and how the bank reads 'SMS ALERT CHRG'
SHAPES = (("hdfc", "upi", True, None), ("sbi", "neft", True, None), ("icici", "imps", True, None), ("pnb", "rtgs", True, "charge"), ("bob", "upi", True, "charge"), ("axis", "cheque", False, None), ("kotak", "neft", True, "charge"))

SQL: dict[str, str] = {
    "summary": f"WITH {PAIRS} " + " UNION ALL ".join(f"SELECT {i}::BIGINT AS line, '{item}' AS item, ({n})::BIGINT AS count, ({a})::DECIMAL(28,2) AS amount FROM sums" for i, (item, n, a) in enumerate(SUMMARY)),
    "bank_transactions": f"WITH {BASE} SELECT * FROM bank",
    "ledger_transactions": f"WITH {BASE} SELECT * FROM ledger",
    "fee_gap": PAIR_K.replace("~", f"{FEE} AS plausible, (b.amount > 0) = (l.amount > 0) AS same_direction"),
    "distinctive_tokens": f"WITH {ALL} SELECT id, array_to_string(list_sort({TOKENS}), ' ') AS tokens FROM txns",
    "token_dice": PAIR_K.replace("~", f"round({DICE}, 6) AS dice"),
    "reference_match": PAIR_K.replace("~", "list_has_any(b.forms, l.forms) AS matches"),
    "citation_label": "SELECT k, CASE WHEN k % 4 = 1 THEN 'read by the model — no source line' WHEN a IS NULL THEN 'location unknown' WHEN k % 4 = 0 THEN 'row ' || a WHEN z <> a THEN coalesce('page ' || p || ', ', '') || 'lines ' || a || '-' || z ELSE coalesce('page ' || p || ', ', '') || 'line ' || a END AS label FROM (SELECT o_orderkey::BIGINT AS k, CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey % 7 + 1 END AS p, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderkey % 90 + 1 END AS a, o_orderkey % 90 + 1 + o_orderkey % 2 AS z FROM orders)",
    "narration_parse": f"WITH {BASE} " + " UNION ALL ".join(f"SELECT k, '{bank}' AS bank, CASE WHEN k % 11 = {i} THEN {repr(charge) if charge else 'NULL'} ELSE '{kind}' END AS kind, CASE WHEN k % 11 <> {i} THEN {N} END AS reference, {f'CASE WHEN k % 11 <> {i} THEN upper(p) END' if party else 'NULL::VARCHAR'} AS counterparty FROM payments" for i, (bank, kind, party, charge) in enumerate(SHAPES)),
    "match_exact_candidates": f"WITH {CANDIDATES} SELECT bank_id, ledger_id, round(similarity, 6) AS similarity, corroboration FROM c0",
    "match_exact": f"WITH RECURSIVE {WALKED} SELECT bank_id, ledger_id, rule, round(similarity, 6) AS similarity, corroboration FROM exact",
    "corroboration_mix": f"WITH RECURSIVE {WALKED} SELECT rule, corroboration, count(*)::BIGINT AS n FROM exact GROUP BY ALL",
    "unmatched_bank": f"WITH RECURSIVE {WALKED} SELECT id, amount FROM lb",
    "unmatched_ledger": f"WITH RECURSIVE {WALKED} SELECT id, amount FROM ll",
    "near_candidates": f"WITH {EDGES} SELECT bank_id, ledger_id, round(similarity, 6) AS similarity FROM e0",
    "match_near": f"WITH {PAIRS} SELECT bank_id, ledger_id, rule, round(similarity, 6) AS similarity, corroboration FROM near",
    "unexplained": f"WITH {PAIRS} SELECT (difference - explained)::DECIMAL(28,2) AS unexplained FROM sums",
    "recon_identity": f"WITH {PAIRS} SELECT difference::DECIMAL(28,2) AS difference, pair_differences::DECIMAL(28,2) AS pair_differences, bank_only::DECIMAL(28,2) AS bank_only, ledger_only::DECIMAL(28,2) AS ledger_only, difference = explained AS holds FROM sums",
    "completeness": f"WITH {PAIRS}, placed AS (SELECT 'bank' AS source, bank_id AS id FROM pairs UNION ALL SELECT 'bank', id FROM ub UNION ALL SELECT 'ledger', ledger_id FROM pairs UNION ALL SELECT 'ledger', id FROM ul) SELECT source, count_if(n = 1)::BIGINT AS placed_once, count_if(n <> 1)::BIGINT AS wrong FROM (SELECT source, id, count(*) AS n FROM placed GROUP BY ALL) GROUP BY source",
    "stage1_exact": f"WITH RECURSIVE {WALKED} SELECT count(*)::BIGINT AS pairs, count_if(b.amount <> l.amount)::BIGINT AS amounts_differ, max(abs(date_diff('day', b.date, l.date)))::BIGINT AS most_days FROM exact JOIN bank b ON b.id = bank_id JOIN ledger l ON l.id = ledger_id",
    "dup_payments": f"WITH {clusters(BASE)} SELECT source, amount, array_to_string(members, ',') AS members, len(members) || ' transactions with identical amount (' || amount || ') and matching description within 1 day(s) of each other (dates: ' || array_to_string(dates, ', ') || ') — possible duplicate payment.' AS reason FROM clusters",
    "threshold_avoidance": f"WITH {ALL} SELECT id, source, t::BIGINT AS threshold, 'Amount ' || abs(amount) || ' is just below the ' || t || ' approval threshold (within 2%).' AS reason FROM (SELECT *, CASE WHEN abs(amount) >= 49000 AND abs(amount) < 50000 THEN 50000 WHEN abs(amount) >= 98000 AND abs(amount) < 100000 THEN 100000 WHEN abs(amount) >= 196000 AND abs(amount) < 200000 THEN 200000 END AS t FROM txns) WHERE t IS NOT NULL",
    "round_numbers": f"WITH {BASE}, r AS (SELECT 'B' || k AS id, CASE WHEN k % 10 = 0 THEN round(a / 1000.0, 0) * 1000 ELSE a END::DECIMAL(18,2) AS amount FROM payments), e AS (SELECT *, abs(amount) % 1000 = 0 AS is_round FROM r WHERE abs(amount) >= 10000), s AS (SELECT count_if(is_round)::DOUBLE / count(*) AS share FROM e) SELECT id, amount, 'Amount ' || abs(amount) || ' is an exact multiple of 1000, which is unusual here (' || round_even(share * 100, 0)::BIGINT || '% of comparable entries are round)' AS reason FROM e, s WHERE is_round AND share <= 0.30",
    "mirrored_entries": f"WITH {ALL}, m0 AS MATERIALIZED (SELECT p.source, p.id AS bank_id, n.id AS ledger_id, p.amount AS size, p.date AS p_date, p.ord AS p_ord, n.date AS n_date, n.ord AS n_ord FROM txns p JOIN txns n ON p.source = n.source AND p.amount = -n.amount AND p.amount > 0 AND abs(date_diff('day', p.date, n.date)) <= 3)"
    + "".join(assign_round(i, "p_date, p_ord, n_date, n_ord", "m") for i in range(3))
    + " SELECT source, bank_id AS positive_id, ledger_id AS negative_id, size FROM (SELECT * FROM km0 UNION ALL SELECT * FROM km1 UNION ALL SELECT * FROM km2)",
    "timing_gaps": f"WITH {BASE}, days AS (SELECT customer, d, arg_min('B' || k, k) AS first_id, arg_max('B' || k, k) AS last_id FROM payments GROUP BY ALL), g AS (SELECT *, lag(d) OVER w AS before, lag(last_id) OVER w AS before_id FROM days WINDOW w AS (PARTITION BY customer ORDER BY d)) SELECT customer, before_id, first_id AS after_id, before AS from_date, d AS to_date, date_diff('day', before, d)::BIGINT AS gap_days FROM g WHERE date_diff('day', before, d) >= 14",
    "dup_collapsed": f"WITH {clusters(PAIRS)}, legs AS (SELECT c.members, list_sort(list(p.ledger_id)) AS other, count(*) AS n, count(p.ledger_id) AS m FROM (SELECT members, unnest(members) AS bank_id FROM clusters WHERE source = 'bank') c LEFT JOIN pairs p USING (bank_id) GROUP BY c.members), both_sides AS (SELECT legs.members, legs.other FROM legs JOIN clusters r ON r.source = 'ledger' AND list_sort(r.members) = legs.other WHERE n = m) SELECT 'bank' AS source, CASE WHEN x.other IS NULL THEN 'one_side' ELSE 'both' END AS kind, array_to_string(list_sort(list_concat(c.members, coalesce(x.other, []))), ',') AS members FROM clusters c LEFT JOIN both_sides x ON x.members = c.members WHERE c.source = 'bank' UNION ALL SELECT 'ledger', 'one_side', array_to_string(list_sort(members), ',') FROM clusters WHERE source = 'ledger' AND list_sort(members) NOT IN (SELECT other FROM both_sides)",
    "match_issues": f"WITH {PAIRS} SELECT bank_id, ledger_id, {ISSUE} AS issue FROM paired",
    "review_amount": f"WITH {PAIRS} SELECT bank_id, ledger_id, amount_gap, date_gap FROM paired WHERE amount_gap <> 0",
    "review_date": f"WITH {PAIRS} SELECT bank_id, ledger_id, amount_gap, date_gap FROM paired WHERE date_gap <> 0",
    "review_weak": f"WITH {PAIRS} SELECT bank_id, ledger_id, amount_gap, date_gap FROM paired WHERE corroboration = 'amount_and_date_only'",
    "classify_unmatched": f"WITH {PAIRS} {reasons('bank', 'ub', 'ledger', 'not yet booked in the ledger', repr('no counterpart on the ledger side'))} UNION ALL {reasons('ledger', 'ul', 'bank', 'not on the statement', 'CASE WHEN u.amount > 0 THEN ' + repr('no counterpart — receipt not yet on the statement') + ' ELSE ' + repr('no counterpart — payment not yet presented') + ' END')}",
    "balance_audit": f"WITH {STATEMENT} SELECT k, status, CASE WHEN status IN ('recovered', 'corrected') THEN moved ELSE amount END AS audited_amount, CASE WHEN status IN ('recovered', 'corrected') THEN amount END AS printed_amount FROM (SELECT *, CASE WHEN moved = amount THEN 'ok' WHEN amount = 0 THEN 'recovered' WHEN abs(moved) = abs(amount) AND moved <> 0 THEN 'corrected' ELSE 'inconsistent' END AS status FROM statement)",
    "footing_check": f"WITH {STATEMENT} SELECT customer::VARCHAR AS file_name, sum(amount)::DECIMAL(18,2) AS extracted, sum(a)::DECIMAL(18,2) AS expected, sum(amount) = sum(a) AS foots FROM statement GROUP BY customer",
    "client_activity": "SELECT c_custkey::BIGINT AS client_id, c_name AS name, count(o_orderkey)::BIGINT AS runs, max(o_orderdate)::DATE AS last_run FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY ALL",
    "run_history": "SELECT o_custkey::BIGINT AS client_id, o_orderkey::BIGINT AS run_id, o_orderdate::DATE AS created, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS place FROM orders",
    "retention_purge": "SELECT l_orderkey::BIGINT AS run_id, count(*)::BIGINT AS documents FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderdate < TIMESTAMP '1995-01-01') GROUP BY l_orderkey",
    "cosine_topk": "WITH v AS (SELECT vec_id::BIGINT AS id, list_transform(embedding, lambda x: x::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y::DOUBLE)))) AS u FROM embeddings), s AS (SELECT q.id AS query, o.id AS found, round(list_inner_product(q.u, o.u), 9) AS score FROM v q JOIN v o ON q.id % 100 = 0 AND o.id <> q.id) SELECT query, found, round(score, 4) AS score, place FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, found) AS place FROM s) WHERE place <= 3",
    "ledger_convention": f"WITH s AS (SELECT 'credit_is_inflow' AS name, (SELECT count_if(similarity >= 0.35) FROM (WITH RECURSIVE {WALKED} SELECT * FROM exact))::BIGINT AS score UNION ALL SELECT 'debit_is_inflow', (SELECT count_if(similarity >= 0.35) FROM (WITH RECURSIVE {TURNED} SELECT * FROM exact))::BIGINT) SELECT name, score, score = (SELECT max(score) FROM s) AS chosen, (SELECT count(DISTINCT score) FROM s) = 1 AS ambiguous FROM s",
    "layout_parse": f"WITH {BASE} SELECT customer::VARCHAR AS file_name, row_number() OVER (PARTITION BY customer ORDER BY d, k) AS ord, d AS date, a AS amount, 'NEFT/N' || lpad(k::VARCHAR, 8, '0') || '/' || upper(p) || CASE WHEN k % 3 = 0 THEN ' invoice ' || p ELSE '' END AS description, 'N' || k AS reference, 'N' || lpad(k::VARCHAR, 8, '0') AS alt, 'ok' AS status FROM payments",
    "sheet_ingest": f"WITH {BASE} SELECT date, amount, description, reference, count(*)::BIGINT AS n FROM ledger GROUP BY ALL",
}

_ROUND = "rounded AS (SELECT *, abs(amount) % 1000 = 0 AS is_round FROM txns WHERE abs(amount) >= 10000), round_share AS (SELECT count_if(is_round)::DOUBLE / count(*) AS share FROM rounded)"
_GAPS = "gap_days AS (SELECT source, date, arg_min(id, ord) AS first_id, arg_max(id, ord) AS last_id FROM txns GROUP BY ALL), gaps AS (SELECT *, lag(date) OVER w AS before, lag(last_id) OVER w AS before_id FROM gap_days WINDOW w AS (PARTITION BY source ORDER BY date)), far AS (SELECT * FROM gaps WHERE date_diff('day', before, date) >= 14)"
_FLAGS = f"""WITH {ALL}, {_ROUND}, {_GAPS}, flags AS MATERIALIZED (
    SELECT 'duplicate_payment' AS rule, string_split(members, ',') AS ids FROM ({SQL["dup_collapsed"]})
    UNION ALL SELECT 'reversed_mirrored_entry', [positive_id, negative_id] FROM ({SQL["mirrored_entries"]})
    UNION ALL SELECT 'unusual_timing_gap', [before_id, first_id] FROM far
    UNION ALL SELECT 'just_below_approval_threshold', [id] FROM ({SQL["threshold_avoidance"]})
    UNION ALL SELECT 'round_number_entry', [id] FROM rounded, round_share WHERE is_round AND share <= 0.30)"""
_MISSING = f"SELECT * FROM ({SQL['classify_unmatched']})"
SQL |= {
    "anomaly_rows": f"{_FLAGS} SELECT rule, source, id, date, amount FROM (SELECT rule, unnest(ids) AS id FROM flags) JOIN txns USING (id)",
    "anomaly_report": f"{_FLAGS}, f AS (SELECT rule, ids, row_number() OVER () AS flag FROM flags) SELECT rule, source, count(*)::BIGINT AS rows, count(DISTINCT flag)::BIGINT AS flags FROM (SELECT rule, flag, unnest(ids) AS id FROM f) JOIN txns USING (id) GROUP BY ALL",
    "run_payload": f"""SELECT 'summary' AS section, NULL::VARCHAR AS bank_id, NULL::VARCHAR AS ledger_id, NULL::VARCHAR AS rule, NULL::VARCHAR AS note, amount AS difference FROM ({SQL["summary"]}) WHERE item = 'Difference to explain'
    UNION ALL SELECT 'matched', bank_id, ledger_id, rule, issue, NULL FROM (WITH {PAIRS} SELECT bank_id, ledger_id, rule, {ISSUE} AS issue FROM paired)
    UNION ALL SELECT 'unmatched_' || source, CASE WHEN source = 'bank' THEN id END, CASE WHEN source = 'ledger' THEN id END, NULL, reason, NULL FROM ({_MISSING})""",
    "headline": f"{_FLAGS} SELECT (SELECT count(*) FROM (WITH {PAIRS} SELECT 1 FROM pairs))::BIGINT AS matched, (SELECT count_if(source = 'bank') FROM ({_MISSING}))::BIGINT AS unmatched_bank, (SELECT count_if(source = 'ledger') FROM ({_MISSING}))::BIGINT AS unmatched_ledger, (SELECT count(*) FROM flags)::BIGINT AS anomalies, (SELECT amount FROM ({SQL['summary']}) WHERE item = 'Difference to explain')::DECIMAL(28,2) AS difference, (SELECT amount FROM ({SQL['summary']}) WHERE item = 'UNEXPLAINED')::DECIMAL(28,2) AS unexplained",
    "model_rows": f"WITH {BASE} SELECT customer, d AS date, 'pay [1] to ' || p AS description, 'N' || k AS reference, a AS amount FROM payments",
    "model_answers": PAIR_K.replace("~", "abs(b.amount - l.amount)::DECIMAL(18,2) AS gap, abs(date_diff('day', b.date, l.date))::BIGINT AS days, (b.ord // 4) % 3 = 0 AS is_match, ((b.ord // 4) % 11) / 10.0::DOUBLE AS confidence, 'rows {of} ' || (b.ord // 4) AS reasoning"),
    "semantic_match": f"""WITH {EXACT},
    units AS (SELECT vec_id::BIGINT AS v, list_transform(embedding, lambda x: x::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y::DOUBLE)))) AS u FROM embeddings),
    n AS (SELECT count(*) AS n FROM embeddings),
    vb AS MATERIALIZED (SELECT lb.*, u FROM lb, n JOIN units ON v = ord % n),
    vl AS MATERIALIZED (SELECT ll.*, u FROM ll, n JOIN units ON v = ord % n),
    met AS (SELECT b.id AS bank_id, l.id AS ledger_id, b.ord AS bank_ord, b.amount AS bank_amount, l.amount AS ledger_amount, round(list_inner_product(b.u, l.u), 9) AS score, l.ord AS ledger_ord FROM vb b, vl l),
    short AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY bank_id ORDER BY score DESC, ledger_ord, ledger_id) AS place FROM met) WHERE place <= 3 AND score >= 0.5),
    q0 AS MATERIALIZED (SELECT * FROM (SELECT bank_id, ledger_id, bank_ord, place, score, round(1 / (1 + abs(bank_amount::DOUBLE - ledger_amount::DOUBLE) / 100), 6) AS confidence FROM short
      WHERE (bank_amount > 0) = (ledger_amount > 0) AND abs(bank_amount - ledger_amount) <= greatest(500, greatest(abs(bank_amount), abs(ledger_amount)) * 0.02)) WHERE confidence >= 0.5)"""
    + "".join(assign_round(i, "confidence DESC, bank_ord, place, ledger_id", "q") for i in range(6))
    + " SELECT bank_id, ledger_id, round(score, 6) AS similarity, confidence FROM (" + " UNION ALL ".join(f"SELECT * FROM kq{i}" for i in range(6)) + ")",
}

SQL["dup_rows"] = f"WITH {clusters(BASE)} SELECT source, amount, unnest(members) AS id, unnest(dates) AS date, len(members)::BIGINT AS n FROM clusters"
_NOTES = (
    "net movement on the statement", "net movement in the books", "bank net less ledger net", "paired between the two documents", "see Review - Amount", "see Review - Date", "see Review - Weak Evidence",
    "on the statement, not in the ledger", "in the ledger, not on the statement", "", "", "", "", "must be 0.00 — anything else means a row was mismatched, double-counted or dropped",
)
SQL["summary_sheet"] = f"""SELECT line + CASE WHEN line > 8 THEN 2 WHEN line > 2 THEN 1 ELSE 0 END AS line, item, count, amount, {list(_NOTES)!r}[line + 1] AS note FROM ({SQL["summary"]})
    UNION ALL SELECT unnest([3, 10])::BIGINT, '', NULL, NULL, ''"""
SQL["workbook_ingest"] = SQL["sheet_ingest"]
_PLACED = f"""{BASE}, printed AS MATERIALIZED (
    SELECT doc, (n // 30 + 1)::BIGINT AS page, k AS line, 100.0::DOUBLE + n % 30 * 15 AS top, said, 'N' || k AS reference, CASE WHEN a < 0 THEN figure END AS debit, CASE WHEN a >= 0 THEN figure END AS credit,
      CASE WHEN k % 7 = 0 THEN figure ELSE ((k * 13 % 100000) / 100.0)::DECIMAL(18,2)::VARCHAR END AS balance, party
    FROM (SELECT customer::VARCHAR AS doc, row_number() OVER (PARTITION BY customer ORDER BY d, k) - 1 AS n, k, a, strftime(d, '%d/%m/%Y') AS said, abs(a)::VARCHAR AS figure, upper(p) AS party FROM payments)),
tokens AS MATERIALIZED (SELECT doc, page, line, top, unnest([said, 'NEFT', party, reference, debit, credit, balance]) AS key, unnest([0, 1, 2, 3, 4, 5, 6]) AS i FROM printed),
words AS MATERIALIZED (SELECT doc, page, line * 8 + i AS word, key, top + CASE WHEN i IN (1, 2) THEN 4 ELSE 0 END AS top,
    [40.0, 100.0, 135.0, 250.0, 350.0, 450.0, 550.0][i + 1]::DOUBLE AS x0, [95.0, 130.0, 180.0, 300.0, 400.0, 500.0, 600.0][i + 1]::DOUBLE AS x1 FROM tokens WHERE key IS NOT NULL),
met AS MATERIALIZED (SELECT t.line, w.* FROM (SELECT DISTINCT doc, page, line, key FROM tokens WHERE key IS NOT NULL) t JOIN words w USING (doc, page, key)),
scored AS (SELECT h.doc, h.page, h.line, h.top AS height, count(DISTINCT m.key) AS score FROM (SELECT DISTINCT doc, page, line, top FROM met) h JOIN met m ON m.doc = h.doc AND m.page = h.page AND m.line = h.line AND abs(m.top - h.top) <= 9 GROUP BY ALL),
best AS (SELECT doc, page, line, arg_max(height, (score, -height)) AS height, max(score) AS score FROM scored GROUP BY ALL),
held AS MATERIALIZED (SELECT m.*, b.height, b.score FROM met m JOIN best b ON m.doc = b.doc AND m.page = b.page AND m.line = b.line AND abs(m.top - b.height) <= 9)"""
_BOX = "round({0}(x0) / 612, 6) AS x0, round({0}(top) / 792, 6) AS y0, round({1}(x1) / 612, 6) AS x1, round(({1}(top) + 8) / 792, 6) AS y1"
SQL |= {
    "locate_lines": f"WITH {_PLACED} SELECT doc, page, line, height, score, count(*)::BIGINT AS words, {_BOX.format('min', 'max')} FROM held GROUP BY doc, page, line, height, score",
    "cell_boxes": f"""WITH {_PLACED}, cells AS (SELECT doc, page, line, unnest(['date', 'reference', 'debit', 'credit', 'balance']) AS field, unnest([said, reference, debit, credit, balance]) AS key, unnest([1, 2, 3, 4, 5]) AS turn FROM printed),
    claims AS (SELECT *, row_number() OVER (PARTITION BY doc, page, line, key ORDER BY turn) AS claim FROM cells WHERE key IS NOT NULL),
    placed AS (SELECT *, row_number() OVER (PARTITION BY doc, page, line, key ORDER BY x0, word) AS claim FROM held),
    taken AS MATERIALIZED (SELECT p.*, c.field FROM placed p LEFT JOIN claims c USING (doc, page, line, key, claim)),
    edges AS (SELECT doc, page, line, max(x1) FILTER (field = 'date') AS after, min(x0) FILTER (field IN ('debit', 'credit', 'balance')) AS before FROM taken GROUP BY ALL)
    SELECT doc, page, line, field, {_BOX.format('', '')} FROM taken WHERE field IS NOT NULL
    UNION ALL SELECT doc, page, line, 'description', {_BOX.format('min', 'max')} FROM taken JOIN edges USING (doc, page, line)
      WHERE field IS NULL AND (after IS NULL OR x0 >= after) AND (before IS NULL OR x1 <= before) GROUP BY doc, page, line""",
}

# Every amount's bank rows choose one after another; what is taken goes along with the walk.
SQL["match_hot_amounts"] = f"""WITH RECURSIVE items AS (SELECT (l_orderkey * 64 + row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice))::BIGINT AS k, l_shipdate::DATE AS d, l_quantity::DECIMAL(18,2) AS amount, substr(md5((l_suppkey % 40)::VARCHAR), 1, 6) AS p FROM lineitem),
bank AS (SELECT 'B' || k AS id, k AS ord, d AS date, amount, 'NEFT ' || p AS description, CASE WHEN k % 3 = 0 THEN 'R' || k END AS reference FROM items),
ledger AS (SELECT 'L' || k AS id, k AS ord, d + (k % 3)::INT AS date, amount, 'Payment to ' || p AS description, CASE WHEN k % 5 <> 0 THEN 'R' || k END AS reference FROM items),
pb AS MATERIALIZED (SELECT *, {TOKENS} AS tokens, {FORMS} AS forms FROM bank),
pl AS MATERIALIZED (SELECT *, {TOKENS} AS tokens, {FORMS} AS forms FROM ledger),
near AS MATERIALIZED (SELECT b.id AS bank_id, list({{'similarity': {SIMILARITY}, 'ledger_id': l.id, 'same': b.date = l.date, 'corroboration': {CORROBORATION}}} ORDER BY {SIMILARITY} DESC, l.id) AS found
    FROM pb b JOIN pl l ON b.amount = l.amount AND abs(date_diff('day', b.date, l.date)) <= 3 GROUP BY b.id),
turns AS MATERIALIZED (SELECT b.amount, b.id AS bank_id, row_number() OVER (PARTITION BY b.amount ORDER BY b.date, b.ord) AS turn, n.found FROM pb b JOIN near n ON n.bank_id = b.id),
walk AS (
    SELECT DISTINCT amount, 0::BIGINT AS turn, []::VARCHAR[] AS taken, NULL::VARCHAR AS bank_id, 0 AS n, turns.found[1] AS pick FROM turns WHERE turn = 1
    UNION ALL
    SELECT amount, turn, CASE WHEN pick IS NULL THEN taken ELSE list_append(taken, pick.ledger_id) END, bank_id, n, pick FROM (
        SELECT amount, turn, taken, bank_id, len(free) AS n, CASE WHEN len(free) = 1 OR len(free) > 1 AND free[1].similarity >= 0.85 AND free[1].similarity > free[2].similarity THEN free[1] END AS pick
        FROM (SELECT t.amount, t.turn, w.taken, t.bank_id, list_filter(t.found, lambda x: NOT list_contains(w.taken, x.ledger_id)) AS free FROM walk w JOIN turns t ON t.amount = w.amount AND t.turn = w.turn + 1)))
SELECT bank_id, pick.ledger_id AS ledger_id, 'exact_amount_' || CASE WHEN pick.same THEN 'same_date' ELSE 'near_date' END || CASE WHEN n > 1 THEN '_fuzzy_desc' ELSE '' END AS rule, round(pick.similarity, 6) AS similarity, pick.corroboration AS corroboration
FROM walk WHERE bank_id IS NOT NULL AND pick IS NOT NULL"""
