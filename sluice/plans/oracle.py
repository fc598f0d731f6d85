"""The registered queries in SQL, for comparison on the same tables."""

from __future__ import annotations

import re

from sluice.functions import codes
from sluice.functions.codes import INDEPENDENT, TRANSFER_TYPES
from sluice.operators.profiles import LISTS
from sluice.plans.queries import DOCUMENT_SEARCH, MERGED_CYCLES, REACH_ROOTS, SEARCHES, TERM, VIEWED_CANDIDATE, VIEWED_COMMITTEE, VIEWED_NAME
from sluice.sources.fixtures import LOADED_CYCLES


def _list(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


def _values(rows) -> str:
    return ", ".join("(" + ", ".join("'" + str(v).replace("'", "''") + "'" for v in r) + ")" for r in rows)


def _party(column: str) -> str:
    return f"CASE WHEN {column} IN ('REP', 'DEM') THEN {column} WHEN {column} IN ({_list(INDEPENDENT)}) THEN 'IND' WHEN {column} IN ('', 'UNK', '???') THEN 'UNK' ELSE 'OTH' END"


def _terms(text: str) -> str:
    plain = f"regexp_replace(lower(regexp_replace({text}, '['',]', '', 'g')), '[^a-z0-9]', ' ', 'g')"
    return f"list_filter(list_distinct(string_split({plain}, ' ')), lambda x: x NOT IN ({_list(codes.STOP_WORDS)}))"


def _avg(amount: str, count: str) -> str:
    return f"CASE WHEN {count} = 0 THEN CAST(0 AS DOUBLE) ELSE CAST({amount} AS DOUBLE) / CAST({count} AS DOUBLE) END"


_D = "CAST({} AS DOUBLE)"
_CYCLES = "(VALUES " + ", ".join(f"({c})" for c in LOADED_CYCLES) + ") AS y(cycle)"
_MEASURES = ("contributions", "other", "transfers", "expenditures")


def _committee_columns(table: str) -> str:
    parts = [(m, f"{m}_amt", f"{m}_txs") for m in _MEASURES]
    parts += [("total_in", "(contributions_amt + other_amt)", "(contributions_txs + other_txs)"), ("total_out", "(transfers_amt + expenditures_amt)", "(transfers_txs + expenditures_txs)")]
    shown = ", ".join(f"{_D.format(a)} AS {p}_amt, CAST({n} AS BIGINT) AS {p}_txs, {_avg(a, n)} AS {p}_avg" for p, a, n in parts)
    return f"{shown}, CAST(contributions_amt + other_amt - transfers_amt - expenditures_amt AS DOUBLE) AS net_balance FROM {table}"


def _committee_sums(rows: str, keys: str = "cycle, cmte_id") -> str:
    sums = ", ".join(f"coalesce(sum(tx_amt) FILTER (measure = '{m}'), CAST(0 AS DECIMAL(28,2))) AS {m}_amt, count(*) FILTER (measure = '{m}') AS {m}_txs" for m in _MEASURES)
    return f"SELECT {keys}, {sums} FROM {rows} GROUP BY {keys}"


def _in_out_columns(key: str, table: str, cycle: str = "cycle, ") -> str:
    return f"""SELECT {cycle}{key}, {_D.format("o")} AS out_amt, CAST(n AS BIGINT) AS out_txs, {_avg("o", "n")} AS out_avg, {_D.format("i")} AS in_amt,
        CAST(m AS BIGINT) AS in_txs, {_avg("i", "m")} AS in_avg, CAST(i - o AS DOUBLE) AS net_balance FROM {table}"""


def _in_out_sums(key: str, rows: str) -> str:
    return f"""SELECT cycle, {key}, coalesce(sum(tx_amt) FILTER (out), CAST(0 AS DECIMAL(28,2))) AS o, count(*) FILTER (out) AS n,
        coalesce(sum(tx_amt) FILTER (NOT out), CAST(0 AS DECIMAL(28,2))) AS i, count(*) FILTER (NOT out) AS m FROM {rows} GROUP BY cycle, {key}"""


#: Common table expressions by name; each may use those before it.
CTES = {
    "fx_committees": """SELECT 'C' || lpad(CAST(s_suppkey AS VARCHAR), 8, '0') AS cmte_id, s_name AS name, 'CITY ' || CAST(s_nationkey AS VARCHAR) AS city, CASE s_nationkey % 5 WHEN 0 THEN 'CA' WHEN 1 THEN 'TX' WHEN 2 THEN 'NY' ELSE 'S' || CAST(s_nationkey AS VARCHAR) END AS state,
        CASE s_suppkey % 6 WHEN 0 THEN 'REP' WHEN 1 THEN 'DEM' WHEN 2 THEN 'NPA' WHEN 3 THEN 'LIB' WHEN 4 THEN '' ELSE 'UN' END AS party FROM supplier""",
    "fx_candidates": """SELECT substr('HSP', CAST(p_partkey % 3 AS INT) + 1, 1) || lpad(CAST(p_partkey AS VARCHAR), 8, '0') AS cand_id, p_name AS name, p_brand AS city, p_type AS state,
        CASE p_partkey % 7 WHEN 0 THEN 'REP' WHEN 1 THEN 'DEM' WHEN 2 THEN 'IND' WHEN 3 THEN 'GRE' WHEN 4 THEN '' ELSE 'DEM' END AS party,
        CASE WHEN p_partkey % 3 = 0 THEN '' ELSE 'C' || lpad(CAST(p_partkey % 10 AS VARCHAR), 8, '0') END AS pcc FROM part WHERE p_partkey % 4 = 1 AND p_partkey % 5 <> 0""",
    "fx_contributions": """SELECT 'C' || lpad(CAST(l.l_suppkey AS VARCHAR), 8, '0') AS filer_id,
        CASE (l.l_orderkey * 7 + l.l_linenumber * 3 + l.l_partkey) % 14 WHEN 0 THEN '10' WHEN 1 THEN '15' WHEN 2 THEN '15E' WHEN 3 THEN '15Z' WHEN 4 THEN '16R' WHEN 5 THEN '17R' WHEN 6 THEN '18'
            WHEN 7 THEN '18G' WHEN 8 THEN '20Y' WHEN 9 THEN '22Y' WHEN 10 THEN '24I' WHEN 11 THEN '24K' WHEN 12 THEN '24T' ELSE '30K' END AS tx_type,
        CASE WHEN CAST(l.l_quantity AS INT) % 10 = 0 THEN 'X' ELSE '' END AS memo_code,
        CASE WHEN l.l_partkey % 97 = 0 THEN 'C9' || lpad(CAST(l.l_partkey % 5 AS VARCHAR), 7, '0') WHEN l.l_partkey % 4 = 0 THEN 'C' || lpad(CAST(l.l_partkey % 9 AS VARCHAR), 8, '0')
            WHEN l.l_partkey % 4 = 1 THEN substr('HSP', CAST(l.l_partkey % 3 AS INT) + 1, 1) || lpad(CAST(l.l_partkey AS VARCHAR), 8, '0') ELSE '' END AS other_id,
        c.c_name AS name, c.c_mktsegment AS employer, CASE WHEN c.c_custkey % 5 = 0 THEN '' ELSE o.o_orderpriority END AS occupation, lpad(CAST(c.c_nationkey AS VARCHAR), 5, '0') AS zip,
        CAST(l.l_extendedprice AS DECIMAL(18,2)) AS tx_amt, CAST(l.l_orderkey AS VARCHAR) || '.' || CAST(l.l_linenumber AS VARCHAR) AS tx_id,
        CAST(year(l.l_shipdate) + year(l.l_shipdate) % 2 AS INT) AS cycle
        FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN customer c ON o.o_custkey = c.c_custkey""",
    "fx_disbursements": """SELECT 'C' || lpad(CAST(o.o_custkey % 10 AS VARCHAR), 8, '0') AS cmte_id, c.c_name AS name, lpad(CAST(c.c_nationkey AS VARCHAR), 5, '0') AS zip,
        CAST(o.o_totalprice AS DECIMAL(18,2)) AS tx_amt, o.o_orderkey AS sub_id, CAST(year(o.o_orderdate) + year(o.o_orderdate) % 2 AS INT) AS cycle FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey""",
    "named": """SELECT cycle, CASE WHEN tx_type = '24I' AND other_id <> '' THEN other_id ELSE filer_id END AS filer_id, CASE WHEN tx_type = '24I' THEN '15E' ELSE tx_type END AS tx_type, memo_code = 'X' AS is_memo,
        CASE WHEN other_id = '' OR tx_type IN ('15E', '15I', '15T', '24I') THEN CASE WHEN occupation <> '' THEN md5(name || ' - ' || employer || ' - ' || occupation || ' - ' || zip) ELSE md5(name || ' - ' || zip) END ELSE other_id END AS other_id,
        tx_amt, tx_id, name, employer, occupation, zip FROM fx_contributions""",
    "ledger": f"""SELECT *, CASE WHEN length(other_id) >= 16 THEN 'individual' WHEN other_id LIKE 'C%' THEN 'committee' WHEN left(other_id, 1) IN ('H', 'S', 'P') THEN 'candidate' ELSE 'individual' END AS bucket,
        (tx_type < '20' OR (tx_type >= '30' AND tx_type < '33')) AS incoming, tx_type IN ({_list(TRANSFER_TYPES)}) AS transfer,
        (tx_type < '20' OR (tx_type >= '30' AND tx_type < '33')) AND (tx_type < '16' OR tx_type > '18') AS contribution, tx_type <> '24T' AS counted FROM named""",
    "expenses": "SELECT cycle, cmte_id, md5(name || ' - ' || zip) AS person, tx_amt, name, zip, sub_id FROM fx_disbursements",
    "filers": """SELECT cmte_id, name, city, state, party, true AS registered FROM fx_committees UNION ALL
        SELECT DISTINCT id, 'Unknown', '???', '???', 'UNK', false FROM (SELECT filer_id AS id FROM ledger UNION SELECT cmte_id FROM expenses) WHERE id NOT IN (SELECT cmte_id FROM fx_committees)""",
    "named_persons": """SELECT other_id AS indv_id, {'name': name, 'employer': employer, 'occupation': occupation, 'zip': zip} AS who, {'kind': 0, 'tx': tx_id} AS tx, cycle FROM ledger WHERE bucket = 'individual' UNION ALL
        SELECT person, {'name': name, 'employer': '', 'occupation': '', 'zip': zip}, {'kind': 1, 'tx': CAST(sub_id AS VARCHAR)}, cycle FROM expenses""",
    "people": "SELECT indv_id, w.name AS name, w.employer AS employer, w.occupation AS occupation, w.zip AS zip FROM (SELECT indv_id, min_by(who, tx) AS w FROM named_persons GROUP BY indv_id)",
    "entities": """SELECT cmte_id AS id, 'committee' AS bucket, name, city, state, party AS employer FROM filers UNION ALL
        SELECT cand_id, 'candidate', name, city, state, party FROM fx_candidates UNION ALL
        SELECT DISTINCT other_id, 'candidate', 'Unknown', '???', '???', 'UNK' FROM ledger WHERE bucket = 'candidate' AND other_id NOT IN (SELECT cand_id FROM fx_candidates) UNION ALL
        SELECT indv_id, 'individual', name, '', '', employer FROM people""",
    "postings_cmte": """SELECT cycle, filer_id AS cmte_id, CASE WHEN incoming THEN CASE WHEN contribution THEN 'contributions' ELSE 'other' END WHEN transfer THEN 'transfers' ELSE 'expenditures' END AS measure, tx_amt
        FROM ledger WHERE NOT is_memo AND (incoming OR tx_type <> '24T')""",
    "all_cmte": f"""SELECT * FROM postings_cmte UNION ALL SELECT cycle, cmte_id, 'expenditures', tx_amt FROM expenses UNION ALL SELECT CAST(y.cycle AS INT), cmte_id, NULL, CAST(0 AS DECIMAL(18,2)) FROM fx_committees, {_CYCLES}""",
    "cmte_sums": _committee_sums("all_cmte"),
    "cmte_totals": "SELECT cycle, cmte_id, " + _committee_columns("cmte_sums"),
    "indv_rows": """SELECT cycle, other_id AS indv_id, incoming AS out, tx_amt FROM ledger WHERE bucket = 'individual' AND NOT is_memo AND (incoming OR tx_type <> '24T') UNION ALL SELECT cycle, person, false, tx_amt FROM expenses""",
    "indv_sums": _in_out_sums("indv_id", "indv_rows"),
    "indv_totals": _in_out_columns("indv_id", "indv_sums"),
    "cand_rows": "SELECT cycle, other_id AS cand_id, incoming AS out, tx_amt FROM ledger WHERE bucket = 'candidate' AND NOT is_memo AND (incoming OR tx_type <> '24T')",
    "cand_sums": _in_out_sums("cand_id", "cand_rows"),
    "cand_totals": _in_out_columns("cand_id", "cand_sums"),
    "edge_rows": """SELECT cycle, 'indv_recipients' AS list_name, other_id AS owner_id, filer_id AS cp_id, tx_amt FROM ledger WHERE incoming AND bucket = 'individual'
        UNION ALL SELECT cycle, 'indv_senders', other_id, filer_id, tx_amt FROM ledger WHERE NOT incoming AND tx_type <> '24T' AND bucket = 'individual'
        UNION ALL SELECT cycle, 'indv_senders', person, cmte_id, tx_amt FROM expenses
        UNION ALL SELECT cycle, 'cand_recipients', other_id, filer_id, tx_amt FROM ledger WHERE incoming AND bucket = 'candidate'
        UNION ALL SELECT cycle, 'cand_senders', other_id, filer_id, tx_amt FROM ledger WHERE NOT incoming AND tx_type <> '24T' AND bucket = 'candidate'
        UNION ALL SELECT cycle, 'top_indv_contributors', filer_id, other_id, tx_amt FROM ledger WHERE incoming AND bucket <> 'committee'
        UNION ALL SELECT cycle, 'top_cmte_contributors', filer_id, other_id, tx_amt FROM ledger WHERE incoming AND bucket = 'committee'
        UNION ALL SELECT cycle, 'transfer_recipients', filer_id, other_id, tx_amt FROM ledger WHERE NOT incoming AND tx_type <> '24T' AND (bucket = 'committee' OR (bucket = 'candidate' AND transfer))
        UNION ALL SELECT cycle, 'top_exp_recipients', filer_id, other_id, tx_amt FROM ledger WHERE NOT incoming AND tx_type <> '24T' AND (bucket = 'individual' OR (bucket = 'candidate' AND NOT transfer))
        UNION ALL SELECT cycle, 'top_exp_recipients', cmte_id, person, tx_amt FROM expenses""",
    "edges": "SELECT cycle, list_name, owner_id, cp_id, sum(tx_amt) AS amt, count(*) AS txs FROM edge_rows GROUP BY ALL",
    "ranked_edges": "SELECT *, row_number() OVER (PARTITION BY cycle, list_name, owner_id ORDER BY amt DESC, cp_id) AS rank FROM edges",
    "cmte_measures": f"""SELECT t.cycle, 'cmte_tx_data' AS bucket, m.category, t.cmte_id AS entity_id, {_party("coalesce(f.party, '')")} AS party,
        CASE m.category WHEN 'rec' THEN total_in_amt WHEN 'donor' THEN transfers_amt ELSE expenditures_amt END AS total
        FROM cmte_totals t LEFT JOIN filers f ON t.cmte_id = f.cmte_id, (VALUES ('rec'), ('donor'), ('exp')) AS m(category)""",
    "indv_measures": """SELECT cycle, 'individuals' AS bucket, m.category, indv_id AS entity_id, 'ALL' AS party, CASE m.category WHEN 'rec' THEN in_amt ELSE out_amt END AS total FROM indv_totals, (VALUES ('rec'), ('donor')) AS m(category)""",
    "pcc_totals": f"""SELECT CAST(y.cycle AS INT) AS cycle, c.cand_id, {_party("c.party")} AS party, CASE WHEN t.cmte_id IS NOT NULL THEN t.total_in_amt ELSE coalesce(d.in_amt, 0) END AS rec,
        CASE WHEN t.cmte_id IS NOT NULL THEN t.transfers_amt ELSE coalesce(d.out_amt, 0) END AS donor, CASE WHEN t.cmte_id IS NOT NULL THEN t.expenditures_amt ELSE CAST(0 AS DOUBLE) END AS exp
        FROM fx_candidates c CROSS JOIN {_CYCLES} LEFT JOIN cmte_totals t ON t.cmte_id = c.pcc AND t.cycle = y.cycle LEFT JOIN cand_totals d ON d.cand_id = c.cand_id AND d.cycle = y.cycle""",
    "cand_measures": """SELECT cycle, 'candidates' AS bucket, m.category, cand_id AS entity_id, party, CASE m.category WHEN 'rec' THEN rec WHEN 'donor' THEN donor ELSE exp END AS total
        FROM pcc_totals, (VALUES ('rec'), ('donor'), ('exp')) AS m(category)""",
    "measures": "SELECT * FROM cmte_measures UNION ALL SELECT * FROM indv_measures UNION ALL SELECT * FROM cand_measures",
    "all_time": "SELECT 'all_time' AS cycle, bucket, category, entity_id, party, CAST(sum(CAST(total AS DECIMAL(28,2))) AS DOUBLE) AS total FROM measures GROUP BY bucket, category, entity_id, party",
    "shown_all": "SELECT DISTINCT cycle, bucket, category, entity_id, unnest(list_distinct([party, 'ALL'])) AS party, total FROM measures WHERE total <> 0",
    "rankings": """SELECT concat_ws('-', CAST(cycle AS VARCHAR), bucket, category, party) AS ranking_id, cycle, bucket, category, party, rank, entity_id, total FROM (
        SELECT *, row_number() OVER (PARTITION BY cycle, bucket, category, party ORDER BY total DESC, entity_id) AS rank FROM shown_all) WHERE rank <= CASE WHEN bucket = 'individuals' THEN 100000 ELSE 500 END""",
    "yearly": """SELECT concat_ws('-', CAST(cycle AS VARCHAR), category, coalesce(party, 'ALL')) AS total_id, cycle, category, coalesce(party, 'ALL') AS party, CAST(sum(CAST(total AS DECIMAL(28,2))) AS DOUBLE) AS total
        FROM cmte_measures GROUP BY GROUPING SETS ((cycle, category, party), (cycle, category))""",
    "active": "SELECT other_id AS id, cycle FROM ledger UNION SELECT filer_id, cycle FROM ledger UNION SELECT cmte_id, cycle FROM expenses UNION SELECT person, cycle FROM expenses",
    "yearly_entities": "SELECT e.*, a.cycle FROM entities e JOIN active a ON e.id = a.id",
    "states": f"SELECT * FROM (VALUES {_values(codes.STATES.items())}) AS s(code, state_name)",
    "parties": f"SELECT * FROM (VALUES {_values(codes.PARTY_NAMES.items())}) AS p(code, party_name)",
    "texts": """SELECT e.id, e.bucket, e.cycle, e.name || '|' || e.city || '|' || coalesce(s.state_name, '') || '|' || CASE WHEN e.bucket = 'individual' THEN e.employer ELSE coalesce(p.party_name, '') END AS texts
        FROM yearly_entities e LEFT JOIN states s ON e.state = s.code LEFT JOIN parties p ON e.employer = p.code""",
    "postings": f"SELECT DISTINCT unnest({_terms('texts')}) AS term, id FROM texts",
    "lookup": """SELECT id, w.name AS name, w.city AS city, w.state AS state, w.employer AS employer, w.bucket AS bucket, years,
        CASE length(id) WHEN 9 THEN substr(id, 8, 2) WHEN 32 THEN substr(id, 1, 2) ELSE '' END AS partition FROM (
        SELECT id, max_by({'name': name, 'city': city, 'state': state, 'employer': employer, 'bucket': bucket}, {'a': name <> 'Unknown', 'b': cycle, 'c': bucket}) AS w,
            list_sort(list(DISTINCT cycle), 'DESC') AS years FROM yearly_entities GROUP BY id)""",
    "doc_postings": f"SELECT DISTINCT unnest({_terms('coalesce(text, chr(32))')}) AS term, doc_id AS id FROM documents",
    "shares": f"""SELECT e.cycle, e.cp_id AS src, e.owner_id AS dst, {_avg("e.amt", "t.contributions_amt")} AS weight FROM edges e JOIN cmte_totals t ON e.cycle = t.cycle AND e.owner_id = t.cmte_id
        WHERE e.list_name IN ('top_indv_contributors', 'top_cmte_contributors') AND t.contributions_amt <> 0""",
    "flows": """SELECT cycle, owner_id AS src, cp_id AS dst, 'donor_out' AS edge_type, amt FROM edges WHERE list_name = 'indv_recipients' UNION ALL SELECT cycle, owner_id, cp_id, 'cmte_out', amt FROM edges WHERE list_name = 'transfer_recipients'
        UNION ALL SELECT cycle, owner_id, cp_id, 'exp_out', amt FROM edges WHERE list_name = 'top_exp_recipients' UNION ALL SELECT cycle, cp_id, owner_id, 'donor_in', amt FROM edges WHERE list_name = 'top_indv_contributors'
        UNION ALL SELECT cycle, cp_id, owner_id, 'cmte_in', amt FROM edges WHERE list_name = 'top_cmte_contributors' UNION ALL SELECT cycle, cp_id, owner_id, 'cand_in', amt FROM edges WHERE list_name = 'cand_senders'""",
}


def sql(body: str) -> str:
    """The statement with the common table expressions that it uses, directly or not."""
    wanted: set[str] = set()

    def use(text: str) -> None:
        for name in CTES:
            if name not in wanted and re.search(rf"\b(FROM|JOIN|IN \(SELECT \w+ FROM)\s+{name}\b", text) or name not in wanted and re.search(rf",\s+{name}\b(?!\.)", text) and re.search(rf"FROM [^()]*,\s+{name}\b", text):
                wanted.add(name)
                use(CTES[name])

    use(body)
    parts = ",\n".join(f"{name} AS ({text})" for name, text in CTES.items() if name in wanted)
    return f"WITH {parts}\n{body}" if parts else body


def _edge(name: str, limited: bool) -> str:
    rank = ", rank" if limited else ""
    where = " AND rank <= 100" if limited else ""
    return f"SELECT cycle, owner_id, cp_id, {_D.format('amt')} AS amt, txs{rank} FROM ranked_edges WHERE list_name = '{name}'{where}"


def _ranks(where: str, most: str = "") -> str:
    return f"SELECT * FROM rankings WHERE {where}{most}"


_MERGED = ", ".join(map(str, MERGED_CYCLES))
_WORDS = "coalesce({0}.name, 'Unknown') AS name, coalesce({0}.city, '???') AS city, coalesce({0}.state, '???') AS state"


def _profile(name: str, owner: str) -> str:
    edge = _edge(name, name.startswith("top_")).replace("SELECT cycle,", f"SELECT '{name}' AS list_name, amt AS exact, cycle,", 1)
    return f"""SELECT x.cycle, x.list_name, x.owner_id, x.cp_id, coalesce(e.name, 'Unknown') AS cp_name, x.amt, x.txs, {_avg("x.exact", "x.txs")} AS avg_amt
        FROM ({edge}) x LEFT JOIN entities e ON x.cp_id = e.id WHERE x.owner_id = '{owner}'"""


def _profiled(kind: str, owner: str, totals: str, shown: str, key: str) -> str:
    """One entity's lists over the merged cycles, cut where they are limited, beside its own words and totals."""
    lists = f"""SELECT list_name, owner_id, cp_id, amt, txs, row_number() OVER (PARTITION BY list_name ORDER BY amt DESC, cp_id) AS rank FROM (
        SELECT list_name, owner_id, cp_id, sum(amt) AS amt, CAST(sum(txs) AS BIGINT) AS txs FROM edges WHERE owner_id = {owner} AND cycle IN ({_MERGED}) AND list_name IN ({_list(LISTS[kind])}) GROUP BY ALL)"""
    return f"""SELECT e.id AS owner_id, e.name, e.city, e.state, e.employer, {shown}, CAST(t.i - t.o AS DOUBLE) AS net_balance, l.list_name, l.cp_id, l.cp_name, l.amt, l.txs, l.avg_amt, l.rank
        FROM (SELECT * FROM entities WHERE id = {owner} AND bucket = '{kind}') e LEFT JOIN ({totals} WHERE {key} = {owner} AND cycle IN ({_MERGED}) GROUP BY {key}) t ON e.id = t.owner_id
        LEFT JOIN (SELECT x.list_name, x.owner_id, x.cp_id, coalesce(c.name, 'Unknown') AS cp_name, CAST(x.amt AS DOUBLE) AS amt, x.txs, {_avg("x.amt", "x.txs")} AS avg_amt, x.rank
            FROM ({lists}) x LEFT JOIN (SELECT id, max(name) AS name FROM entities GROUP BY id) c ON x.cp_id = c.id WHERE x.list_name NOT LIKE 'top%' OR x.rank <= 100) l ON e.id = l.owner_id"""


def _search(text: str) -> str:
    return f"""SELECT id FROM postings WHERE term IN (SELECT unnest({_terms(f"'{text}'")})) GROUP BY id HAVING count(*) = len({_terms(f"'{text}'")})"""


_LOOKUP = "id, name, city, state, employer, bucket, array_to_string(years, ',') AS years, partition"

_BODIES = {
    "split_rows": """SELECT o_orderkey, CAST(o_orderkey AS VARCHAR) AS f0, CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE o_orderpriority END AS f1, o_orderstatus AS f2, '' AS f3,
        CAST(CASE WHEN o_orderkey % 3 = 0 THEN 3 ELSE 4 END AS BIGINT) AS fields FROM orders""",
    "scan_candidates": "SELECT cand_id, name, party, '' AS election_yr, '' AS office_state, '' AS office, pcc, city, state FROM fx_candidates",
    "scan_committees": """SELECT cmte_id, name, '' AS treasurer, city, state, '' AS zip, '' AS designation, '' AS type, CASE WHEN party = '' THEN 'UNK' ELSE party END AS party, '' AS filing_freq, '' AS org_type, '' AS connected_org, '' AS cand_id FROM fx_committees""",
    "scan_campaign_financials": """SELECT CAST(p_partkey AS VARCHAR) AS cand_id, p_name AS name, p_brand AS party, CASE WHEN p_partkey % 5 = 0 THEN CAST(0 AS DOUBLE) ELSE CAST(CAST(p_retailprice AS DECIMAL(18,2)) AS DOUBLE) END AS total_receipts,
        CAST(p_size AS DOUBLE) AS indv_conts, CAST(51.5 AS DOUBLE) AS general_pct, CAST(0 AS DOUBLE) AS total_disb, '2000-12-31' AS coverage_end FROM part""",
    "scan_committee_financials": "SELECT CAST(s_suppkey AS VARCHAR) AS cmte_id, 'Q' AS type, CAST(CAST(s_acctbal AS DECIMAL(18,2)) AS DOUBLE) AS total_receipts, CAST(0 AS DOUBLE) AS total_loans, CAST(s_nationkey AS DOUBLE) AS party_exp, CAST(0 AS DOUBLE) AS debts_owed FROM supplier",
    "scan_contributions": """SELECT CASE WHEN other_id <> '' THEN 'itoth' ELSE 'itcont' END AS source_file, cycle, filer_id, tx_type, memo_code, CAST(sum(tx_amt) AS DOUBLE) AS amt, count(*) AS txs, min(tx_id) AS first_tx, max(name) AS last_name FROM fx_contributions GROUP BY ALL""",
    "scan_disbursements": "SELECT cycle, cmte_id, name, zip, CAST(tx_amt AS DOUBLE) AS tx_amt, sub_id, '2000-02-29' AS tx_date, '' AS purpose FROM fx_disbursements",
    "parse_tx_date": "SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE strftime(o_orderdate, '%Y-%m-%d') END AS tx_date, strftime(o_orderdate, '%Y-%m-%d') AS paid FROM orders",
    "numeric_coercion": "SELECT c_custkey, CASE WHEN c_custkey % 4 < 2 THEN CAST(0 AS DOUBLE) ELSE CAST(CAST(c_acctbal AS DECIMAL(18,2)) AS DOUBLE) END AS amount FROM customer",
    "identity_keys": """SELECT DISTINCT name, employer, occupation, zip, CASE WHEN occupation <> '' THEN md5(name || ' - ' || employer || ' - ' || occupation || ' - ' || zip) ELSE md5(name || ' - ' || zip) END AS indv_id, md5(name || ' - ' || zip) AS org_id FROM fx_contributions""",
    "earmark_rewrite": "SELECT cycle, filer_id, tx_type, bucket, count(*) AS txs, CAST(sum(tx_amt) AS DOUBLE) AS amt FROM ledger GROUP BY ALL",
    "id_bucket": "SELECT DISTINCT other_id, bucket FROM ledger",
    "classify_tx": "SELECT tx_type, bucket, incoming, transfer, contribution, is_memo, counted, count(*) AS txs, CAST(sum(tx_amt) AS DOUBLE) AS amt FROM ledger GROUP BY ALL",
    "resolve_filers": "SELECT * FROM filers",
    "resolve_counterparties": """SELECT DISTINCT l.other_id AS id, l.bucket, coalesce(k.name, 'Unknown') AS name, coalesce(k.registered, false) AS registered FROM ledger l LEFT JOIN (
        SELECT cmte_id AS id, name, registered FROM filers UNION ALL SELECT cand_id, name, true FROM fx_candidates) k ON l.other_id = k.id WHERE l.bucket <> 'individual'""",
    "individuals_dim": "SELECT * FROM people",
    "individuals_kept": "SELECT indv_id, w.name AS name, w.employer AS employer, w.occupation AS occupation, w.zip AS zip FROM (SELECT indv_id, min_by(who, {'load': CASE WHEN cycle > 1998 THEN 0 ELSE 1 END, 'tx': tx}) AS w FROM named_persons GROUP BY indv_id)",
    "unresolved_tx": """SELECT side, cycle, filer_id, other_id, count(*) AS txs, CAST(sum(tx_amt) AS DOUBLE) AS amt FROM (
        SELECT 'filer' AS side, * FROM ledger WHERE filer_id NOT IN (SELECT cmte_id FROM fx_committees UNION SELECT cand_id FROM fx_candidates) UNION ALL
        SELECT 'counterparty', * FROM ledger WHERE bucket <> 'individual' AND other_id NOT IN (SELECT cmte_id FROM fx_committees UNION SELECT cand_id FROM fx_candidates)) GROUP BY side, cycle, filer_id, other_id""",
    "cmte_incoming": "SELECT cycle, cmte_id, " + ", ".join(f"{p}_{n}" for p in ("contributions", "other", "total_in") for n in ("amt", "txs", "avg")) + " FROM (SELECT cycle, cmte_id, " + _committee_columns("(" + _committee_sums("(SELECT * FROM postings_cmte WHERE measure IN ('contributions', 'other'))") + ")") + ")",
    "cmte_outgoing": "SELECT cycle, cmte_id, " + ", ".join(f"{p}_{n}" for p in ("transfers", "expenditures", "total_out") for n in ("amt", "txs", "avg")) + " FROM (SELECT cycle, cmte_id, " + _committee_columns("(" + _committee_sums("(SELECT * FROM postings_cmte WHERE measure IN ('transfers', 'expenditures'))") + ")") + ")",
    "cmte_opex": "SELECT cycle, cmte_id, " + ", ".join(f"{p}_{n}" for p in ("expenditures", "total_out") for n in ("amt", "txs", "avg")) + " FROM (SELECT cycle, cmte_id, " + _committee_columns("(" + _committee_sums("(SELECT cycle, cmte_id, 'expenditures' AS measure, tx_amt FROM expenses)") + ")") + ")",
    "cmte_tx_data": "SELECT * FROM cmte_totals",
    "individual_totals": "SELECT * FROM indv_totals",
    "candidate_direct_totals": "SELECT * FROM cand_totals",
    "candidate_affiliates": """SELECT l.cycle, l.other_id AS cand_id, array_to_string(list_sort(list(DISTINCT l.filer_id)), ',') AS affiliates FROM ledger l LEFT JOIN fx_candidates c ON l.other_id = c.cand_id
        WHERE l.bucket = 'candidate' AND l.incoming AND NOT l.is_memo AND (c.pcc IS NULL OR c.pcc <> l.filer_id) GROUP BY l.cycle, l.other_id""",
    "individual_tx_list": "SELECT cycle, other_id AS indv_id, array_to_string(list_sort(list(tx_id)), ',') AS transactions FROM ledger WHERE bucket = 'individual' AND incoming AND NOT is_memo GROUP BY cycle, other_id",
    "cmte_transfer_list": "SELECT cycle, filer_id AS cmte_id, array_to_string(list_sort(list(tx_id)), ',') AS transactions FROM ledger WHERE bucket = 'committee' AND NOT incoming AND transfer AND NOT is_memo GROUP BY cycle, filer_id",
    "individual_tx_rows": "SELECT cycle, other_id AS indv_id, CAST(floor((row_number() OVER (PARTITION BY cycle, other_id ORDER BY tx_id) - 1) / 1250) AS BIGINT) AS shard, tx_id FROM ledger WHERE bucket = 'individual' AND incoming AND NOT is_memo",
    "cmte_transfer_rows": "SELECT cycle, filer_id AS cmte_id, CAST(floor((row_number() OVER (PARTITION BY cycle, filer_id ORDER BY tx_id) - 1) / 1250) AS BIGINT) AS shard, tx_id FROM ledger WHERE bucket = 'committee' AND NOT incoming AND transfer AND NOT is_memo",
    **{q: _edge(n, False) for q, n in (("edges_indv_recipients", "indv_recipients"), ("edges_indv_senders", "indv_senders"), ("edges_cand_recipients", "cand_recipients"), ("edges_cand_senders", "cand_senders"), ("edges_transfer_recipients", "transfer_recipients"))},
    **{n: _edge(n, True) for n in ("top_indv_contributors", "top_cmte_contributors", "top_exp_recipients")},
    "counterparty_averages": f"SELECT cycle, list_name, owner_id, cp_id, {_avg('amt', 'txs')} AS avg_amt FROM edges",
    "sorted_counterparties": "SELECT cycle, owner_id, string_agg(cp_id, ',' ORDER BY rank) AS counterparties FROM ranked_edges WHERE list_name = 'top_cmte_contributors' AND rank <= 100 GROUP BY cycle, owner_id",
    "entry_top_committees": f"SELECT r.*, {_WORDS.format('f')} FROM rankings r LEFT JOIN filers f ON r.entity_id = f.cmte_id WHERE bucket = 'cmte_tx_data' AND category = 'rec' AND r.party = 'ALL' AND rank <= 10",
    "party_bucket": f"SELECT id, party, {_party('party')} AS party_bucket FROM (SELECT cmte_id AS id, party FROM fx_committees UNION ALL SELECT cand_id, party FROM fx_candidates)",
    "party_names": "SELECT c.cand_id, c.party, coalesce(p.party_name, '') AS party_name FROM fx_candidates c LEFT JOIN parties p ON c.party = p.code",
    "committee_codes": f"""SELECT s_suppkey, designation, org_type, coalesce(d.name, '') AS designation_name, coalesce(o.name, '') AS org_name FROM (
        SELECT s_suppkey, substr('ABDJPUX', CAST(s_suppkey % 7 AS INT) + 1, 1) AS designation, substr('CLMTVWX', CAST(s_suppkey % 7 AS INT) + 1, 1) AS org_type FROM supplier)
        LEFT JOIN (VALUES {_values(codes.DESIGNATIONS.items())}) AS d(code, name) ON designation = d.code LEFT JOIN (VALUES {_values(codes.ORGANISATIONS.items())}) AS o(code, name) ON org_type = o.code""",
    "candidate_codes": "SELECT cand_id, left(cand_id, 1) AS office, CASE left(cand_id, 1) WHEN 'H' THEN 'House' WHEN 'S' THEN 'Senate' ELSE 'President' END AS office_name FROM fx_candidates",
    "candidate_pcc_totals": "SELECT * FROM pcc_totals",
    "entity_measures": "SELECT * FROM measures",
    "rankings_cmte": _ranks("bucket = 'cmte_tx_data'"),
    "rankings_indv": _ranks("bucket = 'individuals'"),
    "rankings_cand": _ranks("bucket = 'candidates'"),
    "rankings_preview": "SELECT ranking_id || '-pre' AS ranking_id, cycle, bucket, category, party, rank, entity_id, total FROM rankings WHERE rank <= 10",
    "rankings_clip": _ranks("rank <= 500"),
    "ranking_threshold": """SELECT cycle, owner_id, cp_id, CAST(amt AS DOUBLE) AS amt, from_end FROM (
        SELECT *, row_number() OVER (PARTITION BY cycle, owner_id ORDER BY rank DESC) AS from_end, count(*) OVER (PARTITION BY cycle, owner_id) AS held FROM ranked_edges WHERE list_name = 'top_indv_contributors' AND rank <= 100) WHERE held >= 100 AND from_end <= 10""",
    "ranking_grid": f"""SELECT g.ranking_id, g.cycle, g.bucket, g.category, g.party, count(r.entity_id) AS entries FROM (
        SELECT concat_ws('-', CAST(y.cycle AS VARCHAR), b.bucket, b.category, p.party) AS ranking_id, CAST(y.cycle AS INT) AS cycle, b.bucket, b.category, p.party FROM {_CYCLES},
            (VALUES ('individuals', 'donor'), ('individuals', 'rec'), ('cmte_tx_data', 'rec'), ('cmte_tx_data', 'donor'), ('cmte_tx_data', 'exp'), ('candidates', 'rec'), ('candidates', 'donor'), ('candidates', 'exp')) AS b(bucket, category),
            (VALUES ('ALL'), ('DEM'), ('REP'), ('IND'), ('OTH'), ('UNK')) AS p(party) WHERE b.bucket <> 'individuals' OR p.party = 'ALL') g LEFT JOIN rankings r ON g.ranking_id = r.ranking_id GROUP BY ALL""",
    "ranking_labels": f"""SELECT DISTINCT r.ranking_id, t.title, p.title AS party_title FROM rankings r JOIN (VALUES {_values(codes.LIST_TITLES.items())}) AS t(code, title) ON r.bucket || '-' || r.category = t.code
        JOIN (VALUES {_values(codes.PARTY_TITLES.items())}) AS p(code, title) ON r.party = p.code""",
    "yearly_totals": "SELECT * FROM yearly",
    "view_yearly_totals": f"""SELECT CAST(p.position AS INT) AS position, p.party, p.party_title, 'Funds Received' AS title, coalesce(y.total, 0) AS total FROM (VALUES {_values([(k, p, codes.PARTY_TITLES[p]) for k, p in enumerate(codes.PARTIES)])}) AS p(position, party, party_title)
        LEFT JOIN (SELECT * FROM yearly WHERE cycle = 1998 AND category = 'rec') y ON p.party = y.party""",
    "all_time_totals": """SELECT concat_ws('-', cycle, category, coalesce(party, 'ALL')) AS total_id, cycle, category, coalesce(party, 'ALL') AS party, CAST(sum(CAST(total AS DECIMAL(28,2))) AS DOUBLE) AS total
        FROM all_time WHERE bucket = 'cmte_tx_data' GROUP BY GROUPING SETS ((cycle, category, party), (cycle, category))""",
    "all_time_rankings": """SELECT concat_ws('-', cycle, bucket, category, party) AS ranking_id, cycle, bucket, category, party, rank, entity_id, total FROM (
        SELECT *, row_number() OVER (PARTITION BY cycle, bucket, category, party ORDER BY total DESC, entity_id) AS rank FROM (SELECT cycle, bucket, category, entity_id, unnest(list_distinct([party, 'ALL'])) AS party, total FROM all_time WHERE total <> 0))
        WHERE rank <= CASE WHEN bucket = 'individuals' THEN 100000 ELSE 500 END""",
    "enrich_rankings": f"SELECT r.*, {_WORDS.format('e')} FROM rankings r LEFT JOIN entities e ON r.entity_id = e.id WHERE r.bucket = 'cmte_tx_data' AND r.category = 'exp'",
    "ranking_entities": "SELECT * FROM entities WHERE id IN (SELECT entity_id FROM rankings)",
    "merge_individual_years": _in_out_columns("indv_id", f"(SELECT indv_id, sum(o) AS o, sum(n) AS n, sum(i) AS i, sum(m) AS m FROM indv_sums WHERE cycle IN ({_MERGED}) GROUP BY indv_id)", ""),
    "merge_candidate_years": _in_out_columns("cand_id", f"(SELECT cand_id, sum(o) AS o, sum(n) AS n, sum(i) AS i, sum(m) AS m FROM cand_sums WHERE cycle IN ({_MERGED}) GROUP BY cand_id)", ""),
    "merge_committee_years": "SELECT cmte_id, " + _committee_columns("(" + _committee_sums(f"(SELECT * FROM all_cmte WHERE cycle IN ({_MERGED}))", "cmte_id") + ")"),
    "merge_tx_lists": f"SELECT other_id AS indv_id, array_to_string(list_sort(list(tx_id)), ',') AS transactions FROM ledger WHERE bucket = 'individual' AND incoming AND NOT is_memo AND cycle IN ({_MERGED}) GROUP BY other_id",
    "merge_edges_years": f"SELECT list_name, owner_id, cp_id, CAST(sum(amt) AS DOUBLE) AS amt, CAST(sum(txs) AS BIGINT) AS txs FROM edges WHERE cycle IN ({_MERGED}) GROUP BY list_name, owner_id, cp_id",
    "merge_top_edges": f"""SELECT list_name, owner_id, cp_id, CAST(amt AS DOUBLE) AS amt, txs, rank FROM (SELECT *, row_number() OVER (PARTITION BY list_name, owner_id ORDER BY amt DESC, cp_id) AS rank FROM (
        SELECT list_name, owner_id, cp_id, sum(amt) AS amt, CAST(sum(txs) AS BIGINT) AS txs FROM edges WHERE cycle IN ({_MERGED}) GROUP BY list_name, owner_id, cp_id)) WHERE rank <= 100""",
    "search_terms": "SELECT id, bucket, cycle, texts FROM texts",
    "tokenize": "SELECT * FROM postings",
    "index_partitions": "SELECT DISTINCT left(term, 1) AS partition FROM doc_postings",
    "lookup_partition": "SELECT id, CASE length(id) WHEN 9 THEN substr(id, 8, 2) WHEN 32 THEN substr(id, 1, 2) ELSE '' END AS partition FROM entities",
    "is_entity_id": """SELECT DISTINCT text, length(text) = 32 OR regexp_full_match(text, '[CHSPchsp][0-9]{8}') AS is_id, CASE WHEN length(text) = 9 THEN upper(text) ELSE lower(text) END AS canonical
        FROM (SELECT lower(id) AS text FROM entities UNION SELECT name FROM entities)""",
    "inverted_index": "SELECT left(term, 1) AS partition, term, array_to_string(list_sort(list(id)), ',') AS ids FROM postings GROUP BY term",
    "posting_shards": """SELECT term, shard, min(id) AS min_id, CASE WHEN shard = last THEN '!' ELSE max(id) END AS max_id, count(*) AS entries FROM (SELECT *, max(shard) OVER (PARTITION BY term) AS last FROM (
        SELECT term, id, CAST(floor((row_number() OVER (PARTITION BY term ORDER BY id) - 1) / 1250) AS BIGINT) AS shard FROM postings)) GROUP BY term, shard, last""",
    "posting_rows": "SELECT term, CAST(floor((row_number() OVER (PARTITION BY term ORDER BY id) - 1) / 1250) AS BIGINT) AS shard, id FROM postings",
    "lookup_overlay": f"SELECT * REPLACE (CASE WHEN bucket = 'committee' THEN 'MOVED' ELSE city END AS city) FROM (SELECT {_LOOKUP} FROM lookup)",
    "document_shards": """SELECT term, shard, min(id) AS min_id, CASE WHEN shard = last THEN '!' ELSE max(id) END AS max_id, count(*) AS entries FROM (SELECT *, max(shard) OVER (PARTITION BY term) AS last FROM (
        SELECT term, lpad(CAST(id AS VARCHAR), 12, '0') AS id, CAST(floor((row_number() OVER (PARTITION BY term ORDER BY id) - 1) / 100) AS BIGINT) AS shard FROM doc_postings)) GROUP BY term, shard, last""",
    "term_frequencies": "SELECT left(term, 1) AS partition, term, count(*) AS ids FROM doc_postings GROUP BY term",
    "build_lookup": f"SELECT {_LOOKUP} FROM lookup",
    "index_stats": """SELECT count(*) AS terms, CAST(sum(n) AS BIGINT) AS postings, CAST(sum(ceil(n / 1250.0)) AS BIGINT) AS shards, (SELECT count(*) FROM lookup) AS lookup_rows,
        (SELECT string_agg(CAST(cycle AS VARCHAR), ',' ORDER BY cycle) FROM (SELECT DISTINCT cycle FROM yearly_entities)) AS cycles FROM (SELECT term, count(*) AS n FROM postings GROUP BY term)""",
    "index_update": "SELECT * FROM postings",
    "index_update_shards": """SELECT term, shard, min(id) AS min_id, CASE WHEN shard = last THEN '!' ELSE max(id) END AS max_id, count(*) AS entries FROM (SELECT *, max(shard) OVER (PARTITION BY term) AS last FROM (
        SELECT term, id, CAST(floor((row_number() OVER (PARTITION BY term ORDER BY id) - 1) / 1250) AS BIGINT) AS shard FROM postings)) GROUP BY term, shard, last""",
    "search_order": " UNION ALL ".join(f"""SELECT query, CAST(row_number() OVER (ORDER BY shards, entries, term) - 1 AS INT) AS place, term, shards, entries FROM (
        SELECT '{t}' AS query, term, CAST(ceil(count(*) / 1250.0) AS BIGINT) AS shards, count(*) AS entries FROM postings WHERE term IN (SELECT unnest({_terms(f"'{t}'")})) GROUP BY term)
        WHERE (SELECT count(DISTINCT term) FROM postings WHERE term IN (SELECT unnest({_terms(f"'{t}'")}))) = len({_terms(f"'{t}'")})""" for t in SEARCHES),
    "search_keywords": f"SELECT {_LOOKUP} FROM lookup WHERE id IN (SELECT id FROM ({_search(SEARCHES[0])})) AND (SELECT count(*) FROM ({_search(SEARCHES[0])})) <= 500",
    "search_status": " UNION ALL ".join(f"SELECT '{t}' AS query, count(*) AS results, CASE WHEN count(*) = 0 THEN 'NO_RESULTS' WHEN count(*) > 500 THEN 'MAX_LENGTH' ELSE 'OK' END AS status FROM ({_search(t)})" for t in SEARCHES),
    "search_documents": _search(DOCUMENT_SEARCH).replace("FROM postings", "FROM doc_postings"),
    "lookup_by_ids": f"""SELECT CAST(a.position AS INT) AS position, a.id, coalesce(l.name, 'Unknown') AS name, l.city, l.state, l.employer, l.bucket, array_to_string(l.years, ',') AS years, l.partition
        FROM (VALUES (0, 'C00000007'), (1, 'C00000001'), (2, 'nothing'), (3, 'C90000001')) AS a(position, id) LEFT JOIN lookup l ON a.id = l.id""",
    "missing_lookup_ids": "SELECT DISTINCT id FROM (SELECT other_id AS id FROM ledger UNION SELECT cmte_id || 'X' FROM fx_committees) WHERE id NOT IN (SELECT id FROM lookup)",
    "term_entities": f"SELECT {_LOOKUP} FROM lookup WHERE id IN (SELECT id FROM postings WHERE term = '{TERM}' ORDER BY id LIMIT 200)",
    "direct_pct": "SELECT * FROM shares",
    # Paths are followed from committee to committee, those of one set of nodes and one end together; each gives its last edge at the end.
    "total_pct": f"""SELECT cycle, source, target, round(sum(pct), 9) AS pct, CAST(sum(paths) AS BIGINT) AS paths, CAST(NULL AS INT) AS max_hops FROM (
        WITH RECURSIVE gives AS MATERIALIZED (SELECT * FROM shares WHERE src LIKE 'C%' AND length(src) = 9 AND src <> dst),
        onward AS MATERIALIZED (SELECT * FROM gives g WHERE EXISTS (FROM gives h WHERE h.cycle = g.cycle AND h.src = g.dst)),
        walk AS (SELECT DISTINCT cycle, src AS source, src AS at, [src] AS nodes, CAST(1 AS DOUBLE) AS pct, CAST(1 AS HUGEINT) AS paths FROM gives
            UNION ALL SELECT w.cycle, w.source, o.dst, list_sort(list_append(w.nodes, o.dst)), sum(w.pct * o.weight), CAST(sum(w.paths) AS HUGEINT)
            FROM walk w JOIN onward o ON o.cycle = w.cycle AND o.src = w.at WHERE NOT list_contains(w.nodes, o.dst) GROUP BY w.cycle, w.source, o.dst, list_sort(list_append(w.nodes, o.dst)))
        SELECT w.cycle, w.source, g.dst AS target, w.pct * g.weight AS pct, w.paths FROM walk w JOIN gives g ON g.cycle = w.cycle AND g.src = w.at WHERE NOT list_contains(w.nodes, g.dst)) GROUP BY cycle, source, target""",
    # Amount over the receiver's total incoming money, taken from the transactions themselves.
    "graph_edges": f"""SELECT f.cycle, f.src, f.dst, f.edge_type, {_avg("f.amt", "coalesce(r.received, 0)")} AS weight FROM flows f LEFT JOIN (
        SELECT cycle, id, sum(tx_amt) AS received FROM (
            SELECT cycle, filer_id AS id, tx_amt FROM ledger WHERE incoming AND NOT is_memo
            UNION ALL SELECT cycle, other_id, tx_amt FROM ledger WHERE NOT incoming AND tx_type <> '24T' AND NOT is_memo AND bucket <> 'committee'
            UNION ALL SELECT cycle, person, tx_amt FROM expenses) GROUP BY cycle, id) r ON r.cycle = f.cycle AND r.id = f.dst""",
    "graph_nodes": """SELECT id, CASE WHEN length(id) >= 16 THEN 'indv' WHEN left(id, 1) IN ('H', 'S', 'P') THEN 'cand' WHEN left(id, 1) <> 'C' THEN 'indv' WHEN id IN (SELECT pcc FROM fx_candidates) THEN 'pcc' ELSE 'pac' END AS node_type
        FROM (SELECT src AS id FROM flows UNION SELECT dst FROM flows)""",
    "graph_reach": f"""SELECT cycle, id, hop FROM (WITH RECURSIVE links AS MATERIALIZED (SELECT DISTINCT cycle, src, dst FROM flows), reached(cycle, id, hop) USING KEY (cycle, id) AS (
        SELECT DISTINCT l.cycle, r.id, CAST(0 AS INT) FROM links l, (VALUES {_values([(r,) for r in REACH_ROOTS])}) AS r(id)
        UNION SELECT l.cycle, l.dst, min(f.hop) + 1 FROM reached f JOIN links l ON l.cycle = f.cycle AND l.src = f.id
        WHERE NOT EXISTS (FROM recurring.reached s WHERE s.cycle = l.cycle AND s.id = l.dst) GROUP BY l.cycle, l.dst) SELECT * FROM reached)""",
    "keyed_upsert": "SELECT cmte_id, name, CASE WHEN party = 'REP' THEN 'MOVED' ELSE city END AS city, state, party FROM fx_committees",
    "insert_new_keys": "SELECT cmte_id, CASE WHEN registered THEN name ELSE upper(name) END AS name, city, state, party FROM filers",
    "get_object": "SELECT cycle, cmte_id, total_in_amt, total_out_amt, net_balance FROM cmte_totals WHERE cycle = 1998 AND cmte_id = 'C00000003'",
    "batch_get_found": "SELECT * FROM fx_committees WHERE cmte_id IN (SELECT other_id FROM ledger)",
    "batch_get_missing": "SELECT DISTINCT other_id AS cmte_id FROM ledger WHERE bucket = 'committee' AND other_id NOT IN (SELECT cmte_id FROM fx_committees)",
    "keyset_page": "SELECT * FROM filers WHERE cmte_id > 'C00000005' ORDER BY cmte_id LIMIT 25",
    "keyset_next": "SELECT CASE WHEN count(*) = 25 THEN max(cmte_id) ELSE '' END AS next_key FROM (SELECT cmte_id FROM filers WHERE cmte_id > 'C00000005' ORDER BY cmte_id LIMIT 25)",
    "bucket_counts": "SELECT bucket, count(*) AS keys FROM entities GROUP BY bucket",
    "read_defaults": "SELECT cand_id, name, city, CASE WHEN state = '' THEN '???' ELSE state END AS state, CASE WHEN party = '' THEN '???' ELSE party END AS party, CASE WHEN pcc = '' THEN '0000' ELSE pcc END AS pcc FROM fx_candidates",
    "drop_cycle": "SELECT * FROM yearly WHERE NOT (cycle = 1998 AND category = 'rec')",
    "export_serving": "SELECT t.cycle, t.cmte_id, f.party, t.total_in_amt, t.total_out_amt, CASE WHEN f.party = '' THEN '???' ELSE f.party END AS pk, t.cmte_id AS sk FROM cmte_totals t JOIN filers f ON t.cmte_id = f.cmte_id",
    "export_index": """SELECT left(term, 1) || '.' || CAST(shard AS VARCHAR) AS pk, term AS sk, term, shard, count(*) AS entries FROM (
        SELECT term, CAST(floor((row_number() OVER (PARTITION BY term ORDER BY id) - 1) / 1250) AS BIGINT) AS shard FROM postings) GROUP BY term, shard""",
    "export_lookup": "SELECT partition AS pk, id AS sk, id, name FROM lookup",
    "export_top_individuals": "SELECT * FROM people WHERE indv_id IN (SELECT entity_id FROM rankings WHERE bucket = 'individuals' AND rank <= 50)",
    "incremental_totals": "SELECT cycle, cmte_id, CAST(sum(tx_amt) AS DOUBLE) AS amt, count(*) AS txs FROM fx_disbursements GROUP BY cycle, cmte_id",
    "streamed_ledger": """SELECT 'contributions' AS kind, cycle, count(*) AS txs, CAST(sum(tx_amt) AS DOUBLE) AS amt FROM fx_contributions GROUP BY cycle UNION ALL
        SELECT 'disbursements', cycle, count(*), CAST(sum(tx_amt) AS DOUBLE) FROM fx_disbursements GROUP BY cycle""",
    "streamed_committee_totals": "SELECT * FROM cmte_totals",
    "streamed_individual_totals": "SELECT * FROM indv_totals",
    "streamed_candidate_totals": "SELECT * FROM cand_totals",
    "streamed_lists": """SELECT cycle, list_name, owner_id, cp_id, CAST(amt AS DOUBLE) AS amt, txs, CASE WHEN list_name LIKE 'top%' THEN CAST(rank AS INT) END AS rank FROM ranked_edges WHERE list_name NOT LIKE 'top%' OR rank <= 100""",
    "stream_ingest": "SELECT user_id, count(*) AS events, CAST(sum(CAST(value AS DECIMAL(28,6))) AS DOUBLE) AS total FROM events GROUP BY user_id",
    "view_committee": f"""SELECT x.*, t.total_in_amt, t.total_out_amt, t.net_balance, f.name, f.party FROM ({" UNION ALL ".join(_profile(n, "C00000003") for n in ("top_indv_contributors", "top_cmte_contributors", "transfer_recipients", "top_exp_recipients"))}) x
        JOIN cmte_totals t ON t.cycle = x.cycle AND t.cmte_id = x.owner_id JOIN filers f ON f.cmte_id = x.owner_id""",
    "view_candidate": f"""SELECT x.*, t.in_amt, t.out_amt, t.net_balance FROM ({_profile("cand_recipients", "S00000085")} UNION ALL {_profile("cand_senders", "S00000085")}) x LEFT JOIN cand_totals t ON t.cycle = x.cycle AND t.cand_id = x.owner_id""",
    "view_individual": """SELECT e.cycle, e.owner_id, e.list_name, e.cp_id, f.name AS cp_name, CAST(e.amt AS DOUBLE) AS amt, e.txs, t.in_amt, t.out_amt, t.net_balance FROM edges e LEFT JOIN filers f ON e.cp_id = f.cmte_id
        LEFT JOIN indv_totals t ON t.cycle = e.cycle AND t.indv_id = e.owner_id WHERE e.list_name IN ('indv_recipients', 'indv_senders') AND e.owner_id IN (SELECT md5(name || ' - ' || zip) FROM fx_contributions WHERE name = 'Customer#000000007')""",
    "view_candidate_profile": f"""SELECT p.cycle, c.cand_id, c.name, c.party, CASE left(c.cand_id, 1) WHEN 'H' THEN 'House' WHEN 'S' THEN 'Senate' ELSE 'President' END AS office_name, c.city, c.state, c.pcc,
        coalesce(t.in_amt, 0) AS in_amt, coalesce(t.out_amt, 0) AS out_amt, coalesce(t.net_balance, 0) AS net_balance, p.rec, p.donor, p.exp
        FROM fx_candidates c JOIN pcc_totals p ON p.cand_id = c.cand_id LEFT JOIN cand_totals t ON t.cand_id = c.cand_id AND t.cycle = p.cycle""",
    "profile_committee": _profiled("committee", f"'{VIEWED_COMMITTEE}'", "SELECT cmte_id AS owner_id, sum(CAST(total_in_amt AS DECIMAL(28,2))) AS i, sum(CAST(total_out_amt AS DECIMAL(28,2))) AS o FROM cmte_totals", "CAST(t.i AS DOUBLE) AS total_in_amt, CAST(t.o AS DOUBLE) AS total_out_amt", "cmte_id"),
    "profile_candidate": _profiled("candidate", f"'{VIEWED_CANDIDATE}'", "SELECT cand_id AS owner_id, sum(i) AS i, sum(o) AS o FROM cand_sums", "CAST(t.i AS DOUBLE) AS in_amt, CAST(t.o AS DOUBLE) AS out_amt", "cand_id"),
    "profile_individual": _profiled("individual", f"(SELECT min(indv_id) FROM people WHERE name = '{VIEWED_NAME}')", "SELECT indv_id AS owner_id, sum(i) AS i, sum(o) AS o FROM indv_sums", "CAST(t.i AS DOUBLE) AS in_amt, CAST(t.o AS DOUBLE) AS out_amt", "indv_id"),
    "read_filing_files": "SELECT cycle, cmte_id, name, zip, CAST(tx_amt AS DOUBLE) AS tx_amt, sub_id, '' AS category FROM fx_disbursements",
    "year_gates": f"""SELECT 'contributions' AS file, cycle, count(*) AS lines FROM fx_contributions GROUP BY cycle UNION ALL SELECT 'disbursements', cycle, count(*) FROM fx_disbursements WHERE cycle >= 2004 GROUP BY cycle
        UNION ALL SELECT 'committee_financials', CAST(y.cycle AS INT), count(*) FROM fx_committees CROSS JOIN {_CYCLES} WHERE y.cycle >= 1996 GROUP BY y.cycle""",
    "get_years": f"SELECT cycle, cmte_id, total_in_amt, total_out_amt, net_balance FROM cmte_totals WHERE cmte_id = 'C00000003' AND cycle IN ({_MERGED})",
    "saved_rankings": "SELECT * FROM rankings WHERE bucket = 'cmte_tx_data' AND cycle = 1998",
    "saved_yearly_totals": "SELECT * FROM yearly",
    "get_caches": """SELECT 'preview' AS kind, ranking_id || '-pre' AS id, rank, entity_id, total FROM rankings WHERE rank <= 10 UNION ALL SELECT 'list', ranking_id, rank, entity_id, total FROM rankings
        UNION ALL SELECT 'total', total_id, 0, '', total FROM yearly""",
    "export_entities": "SELECT bucket AS pk, id AS sk, name, city, state, employer FROM entities",
    "export_rankings": "SELECT ranking_id AS pk, lpad(CAST(rank AS VARCHAR), 6, '0') AS sk, entity_id, total FROM rankings",
    "export_totals": "SELECT CAST(cycle AS VARCHAR) AS pk, total_id AS sk, category, party, total FROM yearly",
    "export_index_metadata": """SELECT 'index' AS kind, left(term, 1) AS partition, count(*) AS terms, CAST(sum(ceil(n / 1250.0)) AS BIGINT) AS shards, CAST(sum(n) AS BIGINT) AS entries FROM (SELECT term, count(*) AS n FROM postings GROUP BY term) GROUP BY left(term, 1)
        UNION ALL SELECT 'lookup', partition, CAST(0 AS BIGINT), CAST(0 AS BIGINT), count(*) FROM lookup GROUP BY partition""",
    "missing_item_log": """SELECT id, count(*) AS times, min(batch) AS first_batch FROM (SELECT DISTINCT id, CAST(0 AS INT) AS batch FROM (SELECT other_id AS id FROM ledger UNION SELECT cmte_id || 'X' FROM fx_committees) WHERE id NOT IN (SELECT id FROM lookup)
        UNION ALL SELECT cmte_id || 'Y', 1 FROM fx_committees) GROUP BY id""",
}

ORACLE_SQL = {name: sql(body) for name, body in _BODIES.items()}
