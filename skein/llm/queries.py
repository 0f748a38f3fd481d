"""The queries of this subpackage, each over its whole table, and their SQL where there is any."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm import bpe, embeddings, html, langid, minhash, packing, quality, repair, rules, secrets, toxicity, trie, warc
from skein.llm.common import table

VOCABULARY = "byte_bpe_50k.json"


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.detect(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_documents(table(spark, sf_dir, "documents"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))


def op6_embedding_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.link_vectors(table(spark, sf_dir, "embeddings"))


def op7_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.link_documents(table(spark, sf_dir, "documents"))[0]


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = rules.judge_documents(table(spark, sf_dir, "documents"))
    return judged.withColumn("quality_probability", F.round("quality_probability", 6))


def op11_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"))


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.prefix_trie(table(spark, sf_dir, "conversations"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repair(table(spark, sf_dir, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_toxicity, op2_warc, op3_bpe, op4_secret_scan, op5_packing, op6_embedding_links, op7_minhash, op8_quality_classifier, op9_language_id, op10_quality_rules, op11_html_main_text, op12_conversation_trie,
        op13_conversation_repair,
    )
}


def _secret_sql() -> str:
    """The same patterns; what stands between matches and the matches' lengths give positions."""
    kinds = zip(secrets.KINDS, (secrets.ASSIGN, secrets.ACCESS, secrets.HEX, secrets.OWNED), strict=True)

    def finds(rank: int, kind: str, pattern: str) -> str:
        q = pattern.replace("'", "''")
        value = f"regexp_extract(m[i], '{q}', 2)" if kind == "assign" else "m[i]"
        good = {"assign": f"length({value}) >= {secrets.LEAST_VALUE}", "owned": "regexp_matches(m[i], '[0-9]') and regexp_matches(m[i], '[A-Za-z]')"}.get(kind, "true")
        return f"""select rid, owner, repo, {rank} as rank, '{kind}' as kind, (list_sum(list_transform(p[1:i], lambda z: length(z))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda z: length(z))), 0))::bigint as start, length(m[i]) as size, {value} as value
            from (select rid, owner, repo, m, p, unnest(range(1, len(m) + 1)) as i from (select rid, owner, repo, regexp_extract_all(x, '{q}') as m, regexp_split_to_array(x, '{q}') as p from d)) where {good}"""

    every = " union all ".join(finds(r, k, p) for r, (k, p) in enumerate(kinds))
    return f"""with d as (select row_number() over () as rid, doc_id, coalesce(text, '') as x, coalesce(source, '') as owner, coalesce(doc_id::varchar, '') as repo from documents),
        f as ({every}), c as (select * from f where rank < 3 or not exists (select 1 from f b where b.rid = f.rid and b.rank < 3 and b.start < f.start + f.size and f.start < b.start + b.size)),
        v as (select value, count(distinct owner) as owners, count(distinct (owner, repo)) as repos from c group by value),
        j as (select c.*, owners, repos, owners >= {secrets.WIDE_OWNERS} or repos >= {secrets.WIDE_REPOS} as is_wide, kind || ':' || start || ':' || (start + size) as said from c join v using (value)),
        g as (select rid, count(*) filter (rank = 0) as n_assign, count(*) filter (rank = 1) as n_access, count(*) filter (rank = 2) as n_hex, coalesce(string_agg(said, ',' order by start, rank) filter (rank < 3), '') as base,
            coalesce(string_agg(said, ',' order by start, rank) filter (rank < 3 or not is_wide), '') as spans, count(*) filter (rank = 3 and not is_wide) as n_owned, count(*) filter (not is_wide) as n_live, count(*) filter (is_wide) as n_wide, max(owners) as n_owners, max(repos) as n_repos from j group by rid)
        select doc_id, {", ".join(f"coalesce({c}, 0) as {c}" for c in ("n_assign", "n_access", "n_hex", "n_owned", "n_live", "n_wide", "n_owners", "n_repos"))}, sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans from d left join g using (rid)"""


def _rules_sql() -> str:
    """The same counts and votes; the estimates as a recursion over the vote patterns."""
    votes = {
        "word_length": ("len_ < 3 or len_ > 10", "len_ >= 4 and len_ <= 8"), "symbols": ("sym > 0.1", "sym <= 0.02"), "dup_lines": ("n_lines >= 3 and dup > 0.3", "n_lines >= 3 and dup <= 0.1"), "upper_case": ("upp > 0.4", "upp <= 0.15"),
        "letters": ("let_ < 0.8", "let_ >= 0.95"), "line_ends": ("ended < 0.5", "ended >= 0.9"), "variety": ("n_words >= 50 and dist < 0.3", "n_words >= 50 and dist >= 0.45"), "punctuation": ("pun > 0.4", "pun >= 0.02 and pun <= 0.25"),
    }
    names = list(votes)
    odds = " + ".join(["ln(prior / (1 - prior))", *(f"case {k} when 1 then ln(g[{i}] / (1 - b[{i}])) when 0 then ln((1 - g[{i}]) / b[{i}]) else 0 end" for i, k in enumerate(names, 1))])
    inside = lambda x: f"least(greatest({x}, {rules.EDGE}::double), 1 - {rules.EDGE}::double)"
    rate = lambda v, weight, k: inside(f"(coalesce(sum(case when {k} = {v} then {weight} end), 0) + 1) / (coalesce(sum(case when {k} >= 0 then {weight} end), 0) + 2)")
    estimates = f"{inside('sum(p) / sum(n)')} as prior, [{', '.join(rate(1, 'p', k) for k in names)}] as g, [{', '.join(rate(0, 'n - p', k) for k in names)}] as b"
    moved = ", ".join(["abs(e.prior - old)", *(f"abs(e.g[{i}] - og[{i}]), abs(e.b[{i}] - ob[{i}])" for i in range(1, len(names) + 1))])
    says = lambda v: " + ".join(f"({k} = {v})::int" for k in names)
    return f"""with recursive d as (select row_number() over () as rid, doc_id, coalesce(text, '') as x from documents),
        w as (select *, list_filter(regexp_split_to_array(x, '[\\x20\\x09-\\x0D]+'), lambda y: y <> '') as words, list_filter(string_split(x, chr(10)), lambda l: regexp_matches(l, '[^\\x20\\x09-\\x0D]')) as lines from d),
        win as (select rid, i, count(*) over (partition by rid, gram) as n from (select rid, i, array_to_string(words[i:i + 4], ' ') as gram from (select rid, words, unnest(range(1, len(words) - 3)) as i from w))),
        rep as (select rid, sum(least(5, coalesce(following - i, 5)))::bigint as n_repeat_words from (select rid, i, lead(i) over (partition by rid order by i) as following from win where n > 1) group by rid),
        f as (select doc_id, len(words)::bigint as n_words, coalesce(list_sum(list_transform(words, lambda y: length(y))), 0)::bigint as word_chars, len(regexp_extract_all(x, '[#*$%&|<>]'))::bigint as n_symbols,
            (len(lines) - len(list_distinct(lines)))::bigint as n_dup_lines, coalesce(n_repeat_words, 0) as n_repeat_words, len(lines) as n_lines, len(regexp_extract_all(x, '\\p{{Lu}}')) as n_upper, len(list_filter(words, lambda y: regexp_matches(y, '\\p{{L}}'))) as n_letters,
            len(list_distinct(words)) as n_distinct, len(list_filter(words, lambda y: regexp_matches(y, '[^\\p{{L}}\\p{{N}}]$'))) as n_punct, len(list_filter(lines, lambda l: regexp_matches(l, '[.!?:…。！？]["''”»)]*[\\x20\\x09-\\x0D]*$'))) as n_ended from w left join rep using (rid)),
        s as (select *, word_chars / greatest(n_words, 1)::double as len_, n_symbols / greatest(n_words, 1)::double as sym, n_dup_lines / greatest(n_lines, 1)::double as dup, n_ended / greatest(n_lines, 1)::double as ended, n_upper / greatest(word_chars, 1)::double as upp,
            n_letters / greatest(n_words, 1)::double as let_, n_distinct / greatest(n_words, 1)::double as dist, n_punct / greatest(n_words, 1)::double as pun from f),
        v as (select *, {", ".join(f"case when {b} then 0 when {g} then 1 else -1 end as {k}" for k, (b, g) in votes.items())} from s),
        pat as (select {", ".join(names)}, count(*)::double as n from v group by all),
        first_ as (select {estimates} from (select *, n * ({says(1)} + 1)::double / ({says(1)} + {says(0)} + 2) as p from pat)),
        em as (select 0 as round, prior, g, b, 1::double as moved from first_
            union all select round + 1, e.prior, e.g, e.b, greatest({moved}) from (
                select round, old, og, ob, {estimates} from (select em.round, em.prior as old, em.g as og, em.b as ob, pat.*, n / (1 + exp(-({odds}))) as p from em, pat where round < {rules.ROUNDS} and moved >= {rules.SETTLED}) group by round, old, og, ob) e),
        last_ as (select prior, g, b from em order by round desc limit 1),
        q as (select v.*, 1 / (1 + exp(-({odds}))) as probability, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed from v, last_)
        select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and probability >= 0.5 as kept, round(probability, 6) as quality_probability from q"""


def _crc32(text: str) -> str:
    """The unsigned CRC-32 of a text of ASCII characters, bit by bit."""
    steps = f"list_concat([4294967295], flatten(list_transform(string_split({text}, ''), lambda z: [ascii(z), -1, -1, -1, -1, -1, -1, -1, -1])))"
    return f"xor(list_reduce({steps}, lambda x, y: case when y >= 0 then xor(x, y) else xor(x >> 1, 3988292384 * (x & 1)) end), 4294967295)"


def _trie_sql() -> str:
    """Prefixes as joined digests; every node with each of its ancestors."""
    return f"""with t as (select conv_id as c, coalesce(role, '') as role, coalesce(text, '') as x, turn from conversations where conv_id is not null),
        o as (select *, left(sha256(length(role) || ':' || role || x), 32) as said, len(regexp_extract_all(x, '[^\\x20\\x09-\\x0D]+')) as words from t),
        p as (select *, row_number() over (partition by c order by turn nulls first, said) as pos from o),
        own as (select c, count(*) as own, ({_crc32("c::varchar")}) % 4 as h, c - c % 20 as base from p group by c),
        convs as (select x.c, x.h, x.base, least(x.h, coalesce(y.own, 0)) as got from own x left join own y on y.c = x.base),
        r as (select c, pos - h + got as pos, said, words from p join convs using (c) where pos > h union all select v.c, pos, said, words from convs v join p on p.c = v.base where pos <= h),
        s as (select convs.c, coalesce(list(said order by pos) filter (said is not null), []) as says, coalesce(list(words order by pos) filter (said is not null), []) as counts from convs left join r using (c) group by convs.c),
        m as (select c, d, says, len(says) = d as ends, case when d = 0 then 0 else counts[d] end as words, array_to_string(says[1:d], ',') as here, array_to_string(says[1:d - 1], ',') as above from (select *, unnest(range(0, len(says) + 1)) as d from s)),
        n as (select d, here, any_value(above) as above, any_value(says[1:d]) as says, min(c) as conv_id, count(*) as n, max(words) as words, sha256(coalesce(string_agg(c::varchar, ',' order by c) filter (ends), '')) as ends_sha256 from m group by d, here),
        k as (select n.*, (select count(*) from n b where b.d = n.d + 1 and b.above = n.here) as children from n),
        a as (select d as of_d, array_to_string(says[1:d], ',') as of_here, leaf, saved from (select unnest(range(0, len(says) + 1)) as d, says, (children = 0)::bigint as leaf, (n - 1) * words as saved from k)),
        sums as (select of_d, of_here, sum(leaf)::bigint as n_leaves, sum(saved)::bigint as saved_tokens from a group by all)
        select k.conv_id, k.d as depth, up.conv_id as parent_conv_id, k.n as n_convs, k.children as n_children, n_leaves, saved_tokens, k.ends_sha256
        from k join sums on of_d = k.d and of_here = k.here left join k up on up.d = k.d - 1 and up.here = k.above"""


def _repair_sql() -> str:
    """Least costs with their audits as texts, six digits before the letters, from the last turn to the first."""
    role, text = "coalesce(role, ' ')", "coalesce(text, ' ')"
    plus = lambda cost, letter, v: f"(lpad((left({v}, 6)::int + {cost})::varchar, 6, '0') || '{letter}' || substr({v}, 7))"
    wanted, reads = {0: 2, 1: 2, 2: 3, 3: 2}, {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}

    def edits(s: int) -> str:
        keep = [f"case when stays and ini = '{c}' then {plus('late', 'K', f'v{t}')} end" for (at, c), t in reads.items() if at == s]
        return f"least({', '.join([plus(repair.DELETE, 'D', f'v{s}'), *keep, f'case when stays then {plus(f'late + {repair.REROLE}', 'R', f'v{wanted[s]}')} end'])})"

    first = lambda v, n: plus(repair.INSERT, "I", v) if n == 1 else plus(repair.INSERT, "I", f"({plus(repair.INSERT, 'I', v)})")
    closed = [f"least(b0, {first('b2', 1)}, {first('b3', 2)}) as v0", f"least(b1, {first('b2', 1)}, {first('b3', 2)}) as v1", f"least(b2, {first('b3', 1)}) as v2", f"least(b3, {first('b2', 1)}) as v3"]
    return f"""with recursive d as (select conv_id as c, turn, {role} as role, {text} as text, ({_crc32("coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ')")}) % 20 as code from conversations),
        w as (select c, turn, case code when 4 then 'user' else role end as role, case code when 1 then '' when 2 then translate(text, '.!?', '') else text end as text, unnest(range(case code when 0 then 0 when 3 then 2 else 1 end)) as copy from d),
        k as (select *, md5(length(role) || ':' || role || text) as key from w),
        o as (select *, row_number() over (partition by c order by turn nulls first, key) as i, case when left(role, 1) in ('s', 'u', 'a') then left(role, 1) else '' end as ini from k),
        f as (select *, lag(ini) over (partition by c order by i) as prior, case when not regexp_matches(text, '[^\\x20\\x09-\\x0D]') then 'blank' when row_number() over (partition by c, role, text order by i) > 1 then 'duplicate' when not regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*$') then 'truncated' else '' end as fault from o),
        g as (select c, count(*) as n, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0)::bigint as gaps, count(*) filter (fault = 'blank') as blank, count(*) filter (fault = 'duplicate') as duplicate, count(*) filter (fault = 'truncated') as truncated,
            count(*) filter (prior is not null and prior || ini not in ('su', 'ua', 'au')) as illegal from f group by c),
        dp as (select c, n + 1 as i, '000000' as v0, '000010II' as v1, '000005I' as v2, '000000' as v3 from g
            union all select c, i, {", ".join(closed)} from (select x.c, x.i, {", ".join(f"{edits(s)} as b{s}" for s in range(4))} from
                (select f.c, f.i, v0, v1, v2, v3, ini, fault not in ('blank', 'duplicate') as stays, case fault when 'truncated' then {repair.TRUNCATED} else 0 end as late from dp join f on f.c is not distinct from dp.c and f.i = dp.i - 1) x)),
        best as (select c, left(v0, 6)::bigint as cost, substr(v0, 7) as audit from dp where i = 1),
        letters as (select c, j, audit[j] as letter from (select c, audit, unnest(range(1, length(audit) + 1)) as j from best)),
        counted as (select *, count(*) filter (letter <> 'I') over (partition by c order by j) as i, count(*) filter (letter <> 'D') over (partition by c order by j) as put from letters),
        turned as (select l.c, j, letter, put, f.role, f.text, f.ini from counted l left join f on l.letter <> 'I' and f.c is not distinct from l.c and f.i = l.i where letter <> 'D'),
        opened as (select c, bool_or(put = 1 and letter = 'K' and ini = 's')::int as system from turned group by c),
        said as (select t.c, j, case when letter = 'K' then role when (put - system) % 2 = 1 then 'user' else 'assistant' end || ':' || case when letter = 'I' then '' else text end as line from turned t join opened p on p.c is not distinct from t.c),
        hashed as (select c, string_agg(line, chr(10) order by j) as whole from said group by c)
        select a.conv_id, coalesce(gaps, 0) as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate, coalesce(truncated, 0) as truncated, coalesce(illegal, 0) as illegal, coalesce(cost, 0) as cost, coalesce(audit, '') as audit, sha256(coalesce(whole, '')) as repaired_sha256
        from (select distinct conv_id from conversations) a left join g on g.c is not distinct from a.conv_id left join best on best.c is not distinct from a.conv_id left join hashed h on h.c is not distinct from a.conv_id"""


#: Components by reachability over ``links`` (a, b), both ways; nodes are in ``nodes`` (id).
_REACH = "reach(id, other) as (select id, id from nodes union select r.id, l.b from reach r join links l on l.a = r.other), component as (select id, min(other) as component_id from reach group by id)"

ORACLE_SQL: dict[str, str] = {
    "op2_warc": """with p as (select page_id, coalesce(html, '') as payload, sha1(coalesce(html, '')) as hex from pages),
        f as (select *, min(page_id) over (partition by payload) as first, row_number() over (partition by payload order by page_id) = 1 as response from p)
        select page_id, strlen(payload)::bigint as payload_bytes,
            array_to_string(list_transform(range(0, 32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((((strpos('0123456789abcdef', substr(hex, (5 * k // 4)::bigint + 1, 1)) - 1) * 16 + strpos('0123456789abcdef', substr(hex, (5 * k // 4)::bigint + 2, 1)) - 1) // (2 ** (3 - 5 * k % 4))::bigint) % 32)::bigint + 1, 1)), '') as payload_digest,
            case when response then 'response' else 'revisit' end as record_type, case when not response then first end as refers_to from f""",
    "op4_secret_scan": _secret_sql(),
    "op6_embedding_links": f"""with recursive v as (select vec_id, list_transform(embedding, lambda x: x::double) as e from embeddings where embedding is not null),
        u as (select vec_id, e from v where len(list_filter(e, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(e, lambda x: x <> 0)) > 0),
        links as (select x.vec_id as a, y.vec_id as b from u x join u y on x.vec_id <> y.vec_id and len(x.e) = len(y.e) where list_cosine_similarity(x.e, y.e) >= 0.9::double),
        nodes as (select vec_id as id from embeddings), {_REACH}
        select vec_id, (select count(*) from links where a = vec_id) as n_links, component_id, vec_id = component_id as kept from embeddings join component on id = vec_id""",
    "op7_minhash": f"""with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') as words from documents),
        s as (select doc_id, case when len(words) = 0 then [] when len(words) < 5 then [array_to_string(words, ' ')] else list_distinct(list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' '))) end as shingles from w),
        e as (select doc_id, len(shingles) as n, unnest(shingles) as shingle from s),
        both_ as (select x.doc_id as a, y.doc_id as b, any_value(x.n) as na, any_value(y.n) as nb, count(*) as i from e x join e y on x.shingle = y.shingle and x.doc_id <> y.doc_id group by x.doc_id, y.doc_id),
        links as (select a, b from both_ where 100 * i >= 75 * (na + nb - i)), nodes as (select doc_id as id from documents), {_REACH}
        select doc_id, len(shingles)::bigint as n_shingles, component_id, doc_id = component_id as kept from s join component on id = doc_id""",
    "op10_quality_rules": _rules_sql(),
    "op12_conversation_trie": _trie_sql(),
    "op13_conversation_repair": _repair_sql(),
}
