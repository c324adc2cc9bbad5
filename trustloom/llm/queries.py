"""The subpackage's queries and the SQL that some of them are held against."""

from trustloom.llm import align, ann, bpe, decontaminate, html, langid, licenses, lm, pii, quotes, simhash, topk, trie


def queries():
    return {
        "op1_bpe": bpe.op1_bpe_roundtrip,
        "op2_decontaminate": decontaminate.op2_decontaminate,
        "op3_topk": topk.op3_topk,
        "op4_html": html.op4_html,
        "op5_langid": langid.op5_langid,
        "op6_quotes": quotes.op6_quotes,
        "op7_lm_scores": lm.op7_lm_scores,
        "op8_licenses": licenses.op8_licenses,
        "op9_pii": pii.op9_pii,
        "op10_simhash": simhash.op10_simhash,
        "op11_ann": ann.op11_ann,
        "op12_trie": trie.op12_trie,
        "op13_align": align.op13_align,
    }


def oracle_sql():
    return {"op3_topk": topk.ORACLE_SQL, "op12_trie": trie.ORACLE_SQL}
