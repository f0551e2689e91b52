"""Registered queries of the corpus operators, and their SQL where SQL can express them."""

from .block_labeller import op2_html_extraction
from .collocations import OP11_SQL, op11_collocations
from .gif_media import op7_media_gif
from .language_id import op8_language_id, pages_language
from .lexical_search import OP13_SQL, op13_lexical_search
from .license_scan import op3_license_scans
from .mixing import OP4_SQL, op4_mixing
from .ngram_join import op9_ngram_jaccard
from .packing import op6_best_fit_packing
from .secret_ledger import OP1_SQL, op1_secret_scans
from .simhash import op12_simhash
from .stream_dedup import OP5_SQL, op5_exact_dedup
from .warc import DAMAGED_SQL, OP10_SQL, damaged_pages, op10_warc

QUERIES = {
    f.__name__: f
    for f in (op1_secret_scans, op2_html_extraction, op3_license_scans, op4_mixing, op5_exact_dedup, op6_best_fit_packing, op7_media_gif, op8_language_id, op9_ngram_jaccard, op10_warc, op11_collocations, op12_simhash, op13_lexical_search, pages_language, damaged_pages)
}
ORACLES = {"op1_secret_scans": OP1_SQL, "op4_mixing": OP4_SQL, "op5_exact_dedup": OP5_SQL, "op10_warc": OP10_SQL, "op11_collocations": OP11_SQL, "op13_lexical_search": OP13_SQL, "damaged_pages": DAMAGED_SQL}
