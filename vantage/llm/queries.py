"""The registered queries of this subpackage, one per operator, and their SQL twins
where DuckDB can run one on whole tables; the tests hold the others against a
brute-force version, an exact round trip or held-out accuracy."""

from . import resample, spelling, warc
from .ann import op10_ann
from .classlm import op3_classlm
from .decontam import op5_decontam
from .langid import op8_langid
from .mixing import op2_mixing
from .neardup import op4_neardup
from .quality import op1_quality
from .resample import op11_resample
from .secrets import op6_secrets
from .spelling import op13_spelling
from .tokens import op9_tokens
from .urls import op7_urls
from .warc import op12_warc

QUERIES = {f.__name__: f for f in (op1_quality, op2_mixing, op3_classlm, op4_neardup, op5_decontam, op6_secrets,
                                   op7_urls, op8_langid, op9_tokens, op10_ann, op11_resample, op12_warc,
                                   op13_spelling)}
ORACLE_SQL: dict[str, str] = {"op11_resample": resample.ORACLE_SQL, "op12_warc": warc.ORACLE_SQL,
                              "op13_spelling": spelling.ORACLE_SQL}
