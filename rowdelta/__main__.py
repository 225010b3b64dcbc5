import sys

from rowdelta.cli import main

sys.exit(main())
