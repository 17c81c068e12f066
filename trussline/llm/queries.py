"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trussline.llm import alignment, chat, decontam, licences, mixing, nearcopies, pii, quality, repair, rules, simhash, substring, tokens
from trussline.llm.common import new_path, table

THRESHOLD = 0.3
#: Only for the synthetic tables; a real run passes its own secret.
DEMO_KEY = "demonstration-key"


def default_tokenizer() -> str:
    import public_tokenizers

    return str(Path(public_tokenizers.path("byte_bpe_50k.json")))


def op1_quality_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.fit(quality.labelled_texts(docs, table(spark, sf_dir, "labels"), "quality"))
    scored = quality.score(docs.select("doc_id", "text"), model)
    held = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    seen = decontam.match_benchmark(docs, table(spark, sf_dir, "benchmark"))
    return seen.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), "items_sha256", "contaminated")


def op3_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), DEMO_KEY)


def op4_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = licences.scan_licences(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return seen.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", F.size("spans").cast("long").alias("n_spans"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.repeated_passages(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op6_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearcopies.near_duplicates(table(spark, sf_dir, "documents"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = rules.fit_quality(quality.labelled_texts(docs, table(spark, sf_dir, "labels"), "quality"))
    seen = rules.apply_rules(docs.select("doc_id", "text"), model, THRESHOLD)
    return seen.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    mixed = mixed.select("doc_id", "size", "source_size", "target", "taken", "position")
    return mixed.repartitionByRange("position", "doc_id").sortWithinPartitions("position", "doc_id")


def op9_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "token-shards")
    tokens.write_shards(table(spark, sf_dir, "documents"), path, default_tokenizer())
    return tokens.read_documents(spark, path).select("doc_id", "start", "n_tokens", "ids_crc32")


def op10_preference_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    pairs = chat.preference_pairs(turns, F.floor(F.col("conv_id") / 2), F.col("conv_id") % 2 == 0)
    spans = {f"{s}_mask": F.array_join(F.transform(f"{s}_mask", lambda x: F.concat_ws("-", x["start"].cast("string"), x["end"].cast("string"))), ",") for s in ("chosen", "rejected")}
    return pairs.withColumns(spans)


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repair_conversations(repair.damaged(table(spark, sf_dir, "conversations")))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents")
    seen = alignment.align_tokenizers(docs, default_tokenizer(), str(Path(public_tokenizers.path("piece_bpe_32k.model"))))
    return seen.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def op13_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = simhash.simhash_groups(table(spark, sf_dir, "documents"))
    return seen.select("doc_id", simhash.as_hex("print").alias("fingerprint"), "component_id")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "op1_quality_neighbours": op1_quality_neighbours, "op2_decontamination": op2_decontamination, "op3_pseudonyms": op3_pseudonyms,
    "op4_licence_scan": op4_licence_scan, "op5_substring_dedup": op5_substring_dedup, "op6_order_minhash": op6_order_minhash,
    "op7_quality_rules": op7_quality_rules, "op8_mixing": op8_mixing, "op9_token_shards": op9_token_shards,
    "op10_preference_pairs": op10_preference_pairs, "op11_conversation_repair": op11_conversation_repair, "op12_token_alignment": op12_token_alignment,
    "op13_simhash": op13_simhash, "pipeline": pipeline,
}

_FOLDED = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_RAW = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

SQL = {
    "op2_decontamination": f"""
        with item as (select cast(item_id as varchar) as item, {_FOLDED} as w from benchmark),
        windows as (
            select distinct item, len(w) as n, array_to_string(w, ' ') as gram from item where len(w) between 1 and 12
            union
            select distinct item, 13, array_to_string(w[i:i + 12], ' ') from (select item, w, unnest(range(1, len(w) - 11)) as i from item where len(w) >= 13)
        ),
        sizes as (select distinct n from windows),
        words as (select row_number() over () as r, doc_id, {_FOLDED} as w from documents),
        hits as (
            select r, i, g.n, windows.item from (
                select r, i, n, array_to_string(w[i:i + n - 1], ' ') as gram
                from (select r, w, n, unnest(range(1, len(w) - n + 2)) as i from words, sizes where len(w) >= n)
            ) g join windows using (n, gram)
        ),
        per as (
            select r, count(distinct place) as n_hit from (select r, unnest(range(i, i + n)) as place from (select distinct r, i, n from hits)) group by r
        ),
        named as (select r, count(*) as n_items, string_agg(item, ',' order by item) as items from (select distinct r, item from hits) group by r)
        select doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
            sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
        from words left join per using (r) left join named using (r)""",
    "op5_substring_dedup": f"""
        with words as (select row_number() over () as r, doc_id, {_RAW} as w from documents),
        grams as (select r, doc_id, i, array_to_string(w[i:i + 49], ' ') as gram from (select r, doc_id, w, unnest(range(1, len(w) - 48)) as i from words where len(w) >= 50)),
        least as (select gram, min(doc_id) as first from grams group by gram),
        gone as (select distinct r, place from (select r, unnest(range(i, i + 50)) as place from grams join least using (gram) where doc_id > first)),
        placed as (select r, place, word from (select r, unnest(range(1, len(w) + 1)) as place, unnest(w) as word from words)),
        kept as (select r, string_agg(word, ' ' order by place) as text from placed anti join gone using (r, place) group by r),
        lost as (select r, count(*) as n from gone group by r)
        select doc_id, cast(len(w) as bigint) as n_words, coalesce(n, 0) as n_removed, sha256(coalesce(text, '')) as kept_sha256
        from words left join lost using (r) left join kept using (r)""",
    "op8_mixing": f"""
        with sized as (
            select doc_id, source, text, cast(len({_RAW}) as bigint) as size, md5(coalesce(cast(doc_id as varchar), '') || '|' || coalesce(text, '')) as ord from documents
        ),
        ranked as (
            select source, size as source_size, row_number() over (order by source nulls last) - 1 as rank from (select source, cast(sum(size) as bigint) as size from sized group by source)
        ),
        weighed as (select *, case rank % 3 when 0 then 5.0::double when 1 then 2.0::double else 1.0::double end as weight from ranked),
        filled as (
            select *, row_number() over w as place,
                (sum(source_size) over () * 1.5::double - coalesce(sum(source_size) over (w rows between unbounded preceding and 1 preceding), 0) * 2.0::double)
                / sum(weight) over (w rows between current row and unbounded following) as level
            from weighed window w as (order by source_size / weight, rank)
        ),
        chosen as (select arg_min(level, place) as level from filled where level * weight <= source_size * 2.0::double),
        targets as (
            select source, source_size, rank, coalesce(least(source_size * 2.0::double, chosen.level * weight), source_size * 2.0::double) as target from filled left join chosen on true
        ),
        placed as (
            select doc_id, size, source_size, rank, target, cast(floor(target + 0.5) as bigint) as wanted,
                coalesce(sum(size) over (partition by s.source order by ord, size rows between unbounded preceding and 1 preceding), 0) as begin_at
            from sized s join targets t on s.source is not distinct from t.source
        ),
        turned as (select *, case when source_size > 0 then wanted // source_size else 0 end as rounds from placed),
        asked as (select *, wanted - rounds * source_size as rest, cast(begin_at as double) / wanted as share from turned)
        select doc_id, size, source_size, target, cast(rounds * size + greatest(0, least(size, rest - begin_at)) as bigint) as taken,
            case when size = 0 or (rounds = 0 and rest <= begin_at) then null
                when share <= 0 then 0.0::double
                when rank % 3 = 0 then 2 * share / (1.5::double + sqrt(1.5::double * 1.5::double + 2 * -1.0::double * share))
                when rank % 3 = 1 then 2 * share / (1.0::double + sqrt(1.0::double + 0 * share))
                else 2 * share / (0.5::double + sqrt(0.5::double * 0.5::double + 2 * 1.0::double * share)) end as position
        from asked""",
    "op11_conversation_repair": r"""
        with recursive crc_steps as (
            select i, i as c, 0 as k from (select unnest(range(256)) as i)
            union all select i, case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, k + 1 from crc_steps where k < 8
        ),
        crc_table as materialized (select list(c order by i) as t from crc_steps where k = 8),
        ids as materialized (
            select conv_id, turn, xor(4294967295, list_reduce(
                list_prepend(4294967295, list_transform(string_split(coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' '), ''), lambda x: ascii(x)::bigint)),
                lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1]))) % 20 as fault
            from (select distinct conv_id, turn from conversations), crc_table
        ),
        convs as materialized (select conv_id, row_number() over () as k from (select distinct conv_id from conversations)),
        faulty as (
            select k, c.turn, fault, case when fault = 4 then 'user' else coalesce(role, ' ') end as role,
                case when fault = 1 then '' when fault = 2 then translate(coalesce(text, ' '), '.!?', '') else coalesce(text, ' ') end as text
            from conversations c join ids on c.conv_id is not distinct from ids.conv_id and c.turn is not distinct from ids.turn
                join convs on c.conv_id is not distinct from convs.conv_id
            where fault <> 0
        ),
        damaged as (select * from faulty union all select * from faulty where fault = 3),
        placed as (
            select *, row_number() over (partition by k, role, text order by i) as again from (
                select *, left(role, 1) as initial, rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) as solid,
                    row_number() over (partition by k order by turn nulls first, role, text) as i from damaged
            )
        ),
        marked as materialized (
            select k, i, turn, role, text, initial, solid = '' as blank, solid <> '' and again > 1 as duplicate, solid <> '' and again = 1 and right(solid, 1) not in ('.', '!', '?') as truncated,
                lead(initial) over (partition by k order by i) as next_initial
            from placed
        ),
        facts as (
            select k, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (blank) as blank, count(*) filter (duplicate) as duplicate,
                count(*) filter (truncated) as truncated, count(*) filter (next_initial is not null and initial || next_initial not in ('su', 'ua', 'au')) as illegal, max(i) as n
            from marked group by k
        ),
        -- costs to go before row i, from the states nothing, s, u, a
        togo as (
            select k, n + 1 as i, 0::bigint as e, 6::bigint as s, 3::bigint as u, 0::bigint as a from facts
            union all
            select k, i, case when gone then e else least(e, u + 3) end, case when gone then s else least(s, u + 3) end, u, a from (
                select k, i, gone, e, s, case when gone then u else least(u, a + 3) end as u, case when gone then a else least(a, u + 3) end as a from (
                    select m.k, m.i, blank or duplicate as gone, 3 * truncated::int as x,
                        case when gone then e + 4 else least(e + 4, u + 3 + x, case initial when 's' then s + x when 'u' then u + x else 1000000000000 end) end as e,
                        case when gone then s + 4 else least(s + 4, u + 3 + x, case initial when 'u' then u + x else 1000000000000 end) end as s,
                        case when gone then u + 4 else least(u + 4, a + 3 + x, case initial when 'a' then a + x else 1000000000000 end) end as u,
                        case when gone then a + 4 else least(a + 4, u + 3 + x, case initial when 'u' then u + x else 1000000000000 end) end as a
                    from togo join marked m on m.k = togo.k and m.i = togo.i - 1
                )
            )
        ),
        h as materialized (select k, i, [e, s, u, a] as h from togo),
        -- one edit a round; state: 1 nothing, 2 s, 3 u, 4 a
        traced as (
            select k, 1::bigint as i, 1 as state, '' as audit, []::varchar[] as lines, n from facts
            union all
            select k, case when letter = 'I' then i else i + 1 end, case letter when 'D' then state when 'K' then kept else other end, audit || letter,
                case letter when 'D' then lines when 'K' then list_append(lines, role || ':' || text)
                    else list_append(lines, case other when 3 then 'user:' else 'assistant:' end || case letter when 'I' then '' else text end) end, n
            from (
                select *, case when i <= n and now[state] = after[state] + 4 then 'D' when now[state] = now[other] + 3 then 'I'
                    when kept > 0 and now[state] = after[kept] + x then 'K' else 'R' end as letter
                from (
                    select t.k, t.i, t.state, t.audit, t.lines, t.n, h.h as now, later.h as after, m.role, m.text, case when state = 3 then 4 else 3 end as other, 3 * coalesce(truncated, false)::int as x,
                        case when initial = 's' and state = 1 then 2 when initial = 'u' and state <> 3 then 3 when initial = 'a' and state = 3 then 4 else 0 end as kept
                    from traced t join h on h.k = t.k and h.i = t.i left join h later on later.k = t.k and later.i = t.i + 1 left join marked m on m.k = t.k and m.i = t.i
                    where t.i <= t.n or t.state in (2, 3)
                )
            )
        )
        select conv_id, coalesce(gaps, 0) as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate, coalesce(truncated, 0) as truncated, coalesce(illegal, 0) as illegal,
            coalesce(h.h[1], 0) as cost, coalesce(audit, '') as audit, sha256(coalesce(array_to_string(lines, chr(10)), '')) as repaired_sha256
        from convs left join facts using (k) left join h on h.k = convs.k and h.i = 1
            left join (select * from traced where i > n and state in (1, 4)) done on done.k = convs.k""",
    "op10_preference_pairs": """
        with turns as (
            select conv_id // 2 as pair_id, conv_id % 2 = 0 as side, turn, coalesce(role, '') as role, replace(coalesce(text, ''), '<|', '< |') as text
            from conversations where conv_id is not null
        ),
        numbered as (select *, row_number() over (partition by pair_id, side order by turn nulls first, role, text) as i from turns),
        a as (select * from numbered where side), b as (select * from numbered where not side),
        joined as (
            select coalesce(a.pair_id, b.pair_id) as pair_id, coalesce(a.i, b.i) as i, coalesce(a.role = b.role and a.text = b.text, false) as same
            from a full join b on a.pair_id = b.pair_id and a.i = b.i
        ),
        common as (select pair_id, coalesce(min(i) filter (not same) - 1, count(*)) as n_common from joined group by pair_id),
        shown as (
            select n.*, n_common, '<|' || role || '|>' || chr(10) || text || chr(10) as line, length('<|' || role || '|>') + 1 as head, n.i <= n_common as shared
            from numbered n join common using (pair_id)
        ),
        spanned as (select *, sum(length(line)) over (partition by pair_id, side, shared order by i) as ends from shown),
        parts as (
            select pair_id, any_value(n_common) as n_common,
                coalesce(string_agg(line, '' order by i) filter (side and shared), '') as prompt,
                coalesce(string_agg(line, '' order by i) filter (side and not shared), '') as chosen,
                coalesce(string_agg(line, '' order by i) filter (not side and not shared), '') as rejected,
                coalesce(string_agg((ends - length(line) + head)::varchar || '-' || ends::varchar, ',' order by i) filter (side and not shared and role = 'assistant'), '') as chosen_mask,
                coalesce(string_agg((ends - length(line) + head)::varchar || '-' || ends::varchar, ',' order by i) filter (not side and not shared and role = 'assistant'), '') as rejected_mask,
                bool_or(side) and bool_or(not side) as both_there
            from spanned group by pair_id
        )
        select pair_id, n_common, prompt, chosen, rejected, chosen_mask, rejected_mask, both_there and chosen_mask <> '' and rejected_mask <> '' as usable from parts""",
}
