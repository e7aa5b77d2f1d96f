"""provscan.plans"""
