"""sparkprep: data preparation and analytics as composable PySpark DataFrame operators."""

import sys as _sys

from pyspark import cloudpickle as _cloudpickle

from sparkprep.operators.aggregate import aggregate, chart_table, create_json, markdown_table
from sparkprep.operators.columns import (
    concat_columns, formula, position_columns, rename, rename_columns, rename_dynamic, select_columns,
)
from sparkprep.operators.compare import compare
from sparkprep.operators.convert import convert_types, datetime_to_text, text_to_datetime
from sparkprep.operators.corpus import (
    fixed_size_chunks, html_to_markdown, parse_html, recursive_chunks, sentence_chunks, to_documents,
)
from sparkprep.operators.correlation import correlation_matrix
from sparkprep.operators.custom import (
    enrich, pandas_transform, python_input, python_output, python_transform, sql_query,
)
from sparkprep.operators.hierarchy import hierarchy_paths
from sparkprep.operators.joins import join_datasets
from sparkprep.operators.json_ops import expand_json_list, explode_json, flatten_json, json_schema, validate_json
from sparkprep.operators.profile import frequencies, preview, schema_table, summary, unique_keys
from sparkprep.operators.reshape import pivot, split_to_columns, split_to_rows, unpivot
from sparkprep.operators.rows import (
    concat_rows, concat_side_by_side, deduplicate, filter_rows, row_id, sample_rows, sort_rows, switch_rows,
)
from sparkprep.operators.text import cleanse, extract, markdown_style, prompt_column, validate_markdown
from sparkprep.plans.pipeline import run_pipeline
from sparkprep.session import drop_copies, local_session
from sparkprep.sources.calendar import dynamic_calendar, generate_calendar
from sparkprep.sources.files import inline, read_csv, read_file, read_json, read_parquet, read_xml
from sparkprep.sources.jdbc import read_jdbc, read_mongodb, write_jdbc
from sparkprep.sources.sinks import (
    deliver, record_payload, write_csv, write_file, write_json, write_parquet, write_xml,
)

__all__ = [name for name in dir() if not name.startswith("_") and name not in ("operators", "plans", "session", "sources")]

# Python tasks carry the small helpers of this package with them, so executors need not have it installed.
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])
