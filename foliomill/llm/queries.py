"""The operators' queries, by name, and their SQL where SQL can express them."""

from __future__ import annotations

from foliomill.llm import clusters, collocations
from foliomill.llm.clusters import op11_centroid_clusters
from foliomill.llm.collocations import op12_collocations
from foliomill.llm.language import op7_language_id
from foliomill.llm.lines import op9_line_dedup
from foliomill.llm.lm import op3_lm_score
from foliomill.llm.mixing import op1_mix_sources
from foliomill.llm.near_dups import op4_minhash_near_dups
from foliomill.llm.neighbours import op13_nearest_neighbours
from foliomill.llm.packing import op5_pack_sequences
from foliomill.llm.secret_scan import op6_secret_scan
from foliomill.llm.transport import op10_transport_stream
from foliomill.llm.urls import op2_url_filter
from foliomill.llm.vectors import op8_embedding_near_dups

QUERIES = {f.__name__: f for f in (op1_mix_sources, op2_url_filter, op3_lm_score, op4_minhash_near_dups, op5_pack_sequences, op6_secret_scan, op7_language_id, op8_embedding_near_dups, op9_line_dedup, op10_transport_stream, op11_centroid_clusters, op12_collocations, op13_nearest_neighbours)}
SQL: dict[str, str] = {op11_centroid_clusters.__name__: clusters.SQL, op12_collocations.__name__: collocations.SQL}
