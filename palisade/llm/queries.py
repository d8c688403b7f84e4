"""The queries of this package and their SQL."""

from palisade.llm import bpe, decontaminate, langid, licenses, linededup, media, neardup, pages, substrings, tokencounts

QUERIES = {
    f.__name__: f
    for f in (
        licenses.op1_license_scan, decontaminate.op2_decontaminate, pages.op3_html_extraction, langid.op4_language_id, bpe.op5_bpe, media.op6_media,
        linededup.op7_line_dedup, substrings.op8_substring_dedup, tokencounts.op9_token_counts, neardup.op10_near_duplicates,
    )
}
ORACLES = {"op7_line_dedup": linededup.SQL, "op1_license_scan": licenses.SQL}
