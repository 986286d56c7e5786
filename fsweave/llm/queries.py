"""The registered queries of the corpus operators, and their SQL where SQL can say it."""

from .op1_warc import OP1_SQL, op1_warc
from .op2_mixing import op2_mixing
from .op3_substring_dedup import OP3_SQL, op3_substring_dedup
from .op4_token_file import op4_token_file
from .op5_decontamination import OP5_SQL, op5_decontamination
from .op6_token_counts import op6_token_counts
from .op7_exact_dedup import OP7_SQL, op7_exact_dedup
from .op8_toxicity import op8_toxicity
from .op9_language_id import op9_language_id
from .op10_jaccard_join import OP10_SQL, op10_jaccard_join
from .op11_vector_codes import OP11_SQL, op11_vector_codes
from .op12_fill_in_middle import OP12_SQL, op12_fill_in_middle
from .op13_sentencepiece import op13_sentencepiece

QUERIES = {
    f.__name__: f
    for f in (op1_warc, op2_mixing, op3_substring_dedup, op4_token_file, op5_decontamination, op6_token_counts, op7_exact_dedup, op8_toxicity, op9_language_id, op10_jaccard_join, op11_vector_codes, op12_fill_in_middle, op13_sentencepiece)
}
SQL = {"op1_warc": OP1_SQL, "op3_substring_dedup": OP3_SQL, "op5_decontamination": OP5_SQL, "op7_exact_dedup": OP7_SQL, "op10_jaccard_join": OP10_SQL, "op11_vector_codes": OP11_SQL, "op12_fill_in_middle": OP12_SQL}
