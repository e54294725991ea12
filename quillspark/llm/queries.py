"""The queries of this subpackage by name, with SQL where SQL can express them."""

from __future__ import annotations

from quillspark.llm.chroma import op4_chroma
from quillspark.llm.decontaminate import OP6_SQL, op6_decontaminate
from quillspark.llm.langid import op7_langid
from quillspark.llm.licenses import op5_licenses
from quillspark.llm.mixing import op10_mixing
from quillspark.llm.neardup import OP3_SQL, op3_neardup
from quillspark.llm.packing import op12_packing
from quillspark.llm.resampling import OP11_SQL, op11_resampling
from quillspark.llm.runs import op13_runs
from quillspark.llm.secrets import op8_secrets
from quillspark.llm.substring import OP9_SQL, op9_substring
from quillspark.llm.tokenstream import op1_tokenstream
from quillspark.llm.toxicity import op2_toxicity


def queries() -> dict:
    return {
        "op1_tokenstream": op1_tokenstream,
        "op2_toxicity": op2_toxicity,
        "op3_neardup": op3_neardup,
        "op4_chroma": op4_chroma,
        "op5_licenses": op5_licenses,
        "op6_decontaminate": op6_decontaminate,
        "op7_langid": op7_langid,
        "op8_secrets": op8_secrets,
        "op9_substring": op9_substring,
        "op10_mixing": op10_mixing,
        "op11_resampling": op11_resampling,
        "op12_packing": op12_packing,
        "op13_runs": op13_runs,
    }


def oracle_sql() -> dict:
    return {"op3_neardup": OP3_SQL, "op6_decontaminate": OP6_SQL, "op9_substring": OP9_SQL, "op11_resampling": OP11_SQL}
