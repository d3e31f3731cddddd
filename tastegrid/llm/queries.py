"""The registered queries of this subpackage and their SQL."""

import functools

from tastegrid.llm.byte_bpe import op9_byte_bpe
from tastegrid.llm.common import ship
from tastegrid.llm.exhaustive_topk import OP5_SQL, op5_exact_topk
from tastegrid.llm.html_text import op7_html_text
from tastegrid.llm.licenses import OP6_SQL, op6_licenses
from tastegrid.llm.mixing import OP3_SQL, op3_mixing
from tastegrid.llm.nn_descent import op2_nn_descent
from tastegrid.llm.sharding import OP12_SQL, op12_sharding
from tastegrid.llm.simhash import op4_simhash
from tastegrid.llm.spelling import OP11_SQL, op11_spelling
from tastegrid.llm.suffix_dedup import op10_suffix_dedup
from tastegrid.llm.token_files import op1_token_files
from tastegrid.llm.toxicity import op8_toxicity
from tastegrid.llm.whitening import op13_whitening

def _shipped(query):
    """query, with this package sent to the executors first."""

    @functools.wraps(query)
    def run(spark, sf_dir):
        ship(spark)
        return query(spark, sf_dir)

    return run


QUERIES = {
    "op4_simhash": _shipped(op4_simhash),
    "op1_token_files": _shipped(op1_token_files),
    "op2_nn_descent": _shipped(op2_nn_descent),
    "op3_mixing": _shipped(op3_mixing),
    "op6_licenses": _shipped(op6_licenses),
    "op7_html_text": _shipped(op7_html_text),
    "op8_toxicity": _shipped(op8_toxicity),
    "op9_byte_bpe": _shipped(op9_byte_bpe),
    "op10_suffix_dedup": _shipped(op10_suffix_dedup),
    "op5_exact_topk": _shipped(op5_exact_topk),
    "op11_spelling": _shipped(op11_spelling),
    "op12_sharding": op12_sharding,
    "op13_whitening": _shipped(op13_whitening),
}

SQL = {
    "op3_mixing": OP3_SQL,
    "op5_exact_topk": OP5_SQL,
    "op6_licenses": OP6_SQL,
    "op11_spelling": OP11_SQL,
    "op12_sharding": OP12_SQL,
}
