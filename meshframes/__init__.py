"""meshframes: DataFrame operators over multiplexed message-frame captures and streams.

Every operator is a plain ``DataFrame -> DataFrame`` function usable with
``DataFrame.transform``; Column helpers live in :mod:`meshframes.functions`.
"""

from meshframes.session import configure, checkpoint_dir, local_session

__all__ = ["configure", "checkpoint_dir", "local_session"]
