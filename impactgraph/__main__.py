"""python -m impactgraph"""

import sys

from .output.cli import main

sys.exit(main())
