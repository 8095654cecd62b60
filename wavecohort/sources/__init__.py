"""Sources and sinks (survey §2.1)."""

from wavecohort.sources.tables import (  # noqa: F401
    drop_table, load_model, load_ticks, materialize, read_table, replace_table,
    save_model, table_exists, write_table,
)
from wavecohort.sources.keyed import read_keyed, write_keyed  # noqa: F401
from wavecohort.sources.casetable import (  # noqa: F401
    read_tensor, save_case_table, tensors_equal, write_tensor,
)
