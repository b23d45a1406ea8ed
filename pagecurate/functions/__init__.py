"""Column expressions (JVM-side, whole-stage-codegen friendly)."""

from pagecurate.functions.text import normalise_text, xml_unescape, speaker_prefix
from pagecurate.functions.links import (
    page_number_from_link, page_stem_from_link, package_id, layout_file_name,
    page_as_string, page_index_from_facs,
)
from pagecurate.functions.meta import (
    record_year, record_chamber, second_chamber, unicameral, relative_page_number,
    even_page, decade, decade_from_path,
)
from pagecurate.functions.boxes import box_corners, box_normalise
from pagecurate.functions.labels import (
    final_target, segment_category, label_name, label_id, label_to_int,
)
from pagecurate.functions.logits import (
    argmax_class, sigmoid_decision, softmax_uncertainty, logit_columns, log_softmax_at,
)

__all__ = [n for n in dir() if not n.startswith("_")]
