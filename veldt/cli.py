"""``python -m veldt.cli validate|run|stats|visualize|report|all --config FILE``: exit 0 when all went well.

``run`` and ``all`` tell of everything; ``stats`` turns spatial statistics on and tells of them, ``visualize`` turns maps and
styles on and tells where they are, ``report`` tells where the report is.
"""

from __future__ import annotations

import argparse
import json
import sys
from dataclasses import replace

from veldt import session
from veldt.errors import EngineError
from veldt.operators import validation
from veldt.plans import request as requests
from veldt.plans import run as runs
from veldt.sinks import files
from veldt.sources import discovery

OVERRIDES = {"before": "before_folder", "after": "after_folder", "aoi": "aoi_path", "output": "output_dir", "method": "method", "threshold": "threshold_method", "percentile": "percentile", "manual-threshold": "manual_threshold", "min-area": "min_area_m2", "grid-size": "spatial_grid_size_m", "permutations": "permutations", "seed": "random_seed", "label": "run_label"}

#: What a verb turns on, and what it tells of a run.
FORCED = {"stats": {"spatial_statistics_enabled": True}, "visualize": {"create_interactive_map": True, "create_qgis_styles": True, "write_intermediate": True}}
TOLD = {
    "stats": lambda result, out: json.dumps(result.moran or {}),
    "visualize": lambda result, out: "\n".join(sorted(p for name, p in out.items() if name.endswith((".qml", ".tif")))),
    "report": lambda result, out: out["report.md"],
}


def main(argv: list[str] | None = None, spark=None) -> int:
    p = argparse.ArgumentParser(prog="veldt")
    p.add_argument("verb", choices=["validate", "run", "stats", "visualize", "report", "all"])
    p.add_argument("--config", required=True)
    p.add_argument("--base")
    p.add_argument("--json", action="store_true")
    p.add_argument("--json-progress", action="store_true")
    p.add_argument("--ml", action=argparse.BooleanOptionalAction)
    kinds = {"percentile": float, "manual-threshold": float, "min-area": float, "grid-size": float, "permutations": int, "seed": int}
    for o in OVERRIDES:
        p.add_argument(f"--{o}", type=kinds.get(o, str))
    a = vars(p.parse_args(argv))
    try:
        request = requests.load(a["config"], a["base"], spatial_ml_enabled=a["ml"], **{f: a[o.replace("-", "_")] for o, f in OVERRIDES.items()})
        request = replace(request, **FORCED.get(a["verb"], {}))
        spark = spark or session.local()
        if a["verb"] in ("validate", "all"):
            table = runs.validate_request(spark, request)
            found = [r.asDict() for r in table.collect()]
            state = validation.status(table)
            if a["verb"] == "validate" or state == "invalid":
                print(json.dumps({"status": state, "issues": found}) if a["json"] else "\n".join([state, *(f"{i['severity']}: {i['code']}: {i['message']}" for i in found)]))
                return int(state == "invalid")
        tell = (lambda stage, percent: print(json.dumps({"type": "progress", "stage": stage, "percent": percent}), flush=True)) if a["json_progress"] else None
        result = runs.run_pipeline(spark, request, tell)
        inputs = [x for f in (request.before_folder, request.after_folder) for x in discovery.discover(spark, f).values()]
        out = files.export(spark, result, request, inputs)
        if a["verb"] in TOLD and not a["json_progress"]:
            print(TOLD[a["verb"]](result, out))
            return 0
        print(json.dumps({"type": "result", "manifest": out["run_manifest.json"], "summary": result.summary, "outputs": out}, default=str))
        return 0
    except EngineError as e:
        print(json.dumps({"type": "error", "message": e.user_message}) if a["json"] or a["json_progress"] else f"error: {e}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
