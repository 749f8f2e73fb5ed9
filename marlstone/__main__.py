import sys

from marlstone.service.cli import main

sys.exit(main())
