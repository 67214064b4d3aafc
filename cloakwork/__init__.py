"""cloakwork: a Spark-first engine for de-identification and text analytics."""

from cloakwork.operators.detect import detect, detect_spans, mask_text
from cloakwork.operators.restore import restore
from cloakwork.plans.deid import DeidPlan, pseudonymize
from cloakwork.plans.gate import Gate, deidentify_outbound, deidentify_responses, mask_coordinates

__all__ = ["DeidPlan", "Gate", "deidentify_outbound", "deidentify_responses", "detect", "detect_spans", "mask_coordinates", "mask_text", "pseudonymize", "restore"]
__version__ = "0.1.0"
