"""provscan.streaming"""
