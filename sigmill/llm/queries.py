"""The corpus operators' queries and, where SQL can express them, their SQL."""

from .histogram_topk import OP10_SQL, op10_histogram_topk
from .language_crf import op1_language_crf
from .minhash_dedup import op3_minhash_dedup
from .mjpeg_media import op9_mjpeg_media
from .poisson_mix import OP7_SQL, op7_poisson_mix
from .pow2_packing import op6_pow2_packing
from .suffix_dedup import op8_suffix_dedup
from .superkmer_dedup import op5_superkmer_dedup
from .toxicity_knn import op2_toxicity_knn
from .warc_derivatives import op4_warc_derivatives



def pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "op1_language_crf": op1_language_crf,
    "op2_toxicity_knn": op2_toxicity_knn,
    "op3_minhash_dedup": op3_minhash_dedup,
    "op4_warc_derivatives": op4_warc_derivatives,
    "op5_superkmer_dedup": op5_superkmer_dedup,
    "op6_pow2_packing": op6_pow2_packing,
    "op7_poisson_mix": op7_poisson_mix,
    "op8_suffix_dedup": op8_suffix_dedup,
    "op9_mjpeg_media": op9_mjpeg_media,
    "op10_histogram_topk": op10_histogram_topk,
    "pipeline": pipeline,
}
ORACLES = {"op7_poisson_mix": OP7_SQL, "op10_histogram_topk": OP10_SQL}


def _pipeline_sql() -> dict[str, str]:
    import corpus_pipeline

    return {"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {}


ORACLES |= _pipeline_sql()
