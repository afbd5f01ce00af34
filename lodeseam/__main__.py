import sys

from lodeseam.cli import main

sys.exit(main())
