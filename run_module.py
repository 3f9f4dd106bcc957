"""Check the queries of some query modules: python run_module.py q_popgen q_variants [/sf_dir]"""

import sys

import check
from genespark.plans import load

if __name__ == "__main__":
    mods = [a for a in sys.argv[1:] if not a.startswith("/")]
    dirs = [a for a in sys.argv[1:] if a.startswith("/")]
    names = [n for n, f in load().QUERIES.items() if f.__module__.split(".")[-1] in mods]
    sys.exit(check.main(names + dirs, exact=True))
